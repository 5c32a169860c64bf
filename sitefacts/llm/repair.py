"""Repair of turn order: the cheapest edits that make the roles `(s?(ua)+)?`, by a square-root checkpointed DP.

A row is its role's initial and its first fault: blank (no visible character), duplicate (role and text seen earlier
in the conversation), truncated (last visible character not `.!?`). Edits: Keep 0, Rerole to user or assistant 1,
Delete 2 (needed for blank and duplicate rows), Insert an empty user or assistant 5; an undeleted truncated row adds
5. State-cost vectors (start, after system, after user, after assistant) run backward over the rows. Only those at
every sqrt(n)-th row are stored; the walk forward recomputes one block of them at a time and takes the ASCII-least
edit among the tight ones. A vector less its least value takes few forms, so that a step is a table lookup.

Spark's part: rows become small records (keys, text digest, code); equal rows are one record with a count, duplicates
are found by a join with the first of each (role, digest), and records are range-partitioned by conversation and
place, so one conversation may fill many tasks. A task cuts its records into blocks of at most `most` codes, one byte
each. Conversations inside one block are repaired there. Others pass on a block's min-plus matrix: backward vectors at
block ends come from the matrices, exits for each of the four entries from the blocks, entries from the exits, and the
edits from the blocks again, so that no task holds more than one block, or 100 bytes a block. Last, texts go once to
their conversation, in order behind its edits, and are hashed as they stream by: a SHA-256 has no parallel form,
so here alone a conversation is one task, in constant memory beside its audit, which is one value of the result.

Null role and text count as one space, null conv_id and turn as one space in the damage key; a null conv_id is a
conversation of its own and null turns come first. Rows of one turn are in order of (role, MD5 of the text), by
which texts count as equal. An
empty role has no initial and is never kept. Very long texts and conversations are whole; an empty table gives no
rows. Further columns are ignored.
"""

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.workdir import shared_dir

FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS, OTHER = "sua", 3
KEEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}  # (state, initial) to the next state
NEXT = (2, 2, 3, 2)  # the state after a rerole or insert, whose role the state decides
RIGHT = (True, False, False, True)  # states in which the roles are whole
REROLE, DELETE, INSERT, LATE = 1, 2, 5, 5
INF = float("inf")
END = (0, 10, 5, 0)  # inserts that finish the last pair
BLANKS = " \t\n\x0b\x0c\r"


def _inserts(costs):
    """Costs and letters with any number of inserts before the edits given for each state."""
    costs = list(costs)
    for _ in range(3):
        for q in range(4):
            letters, cost, to = costs[q]
            more = costs[NEXT[q]]
            if (cost + 0, letters) > (more[1] + INSERT, "I" + more[0]) and more[1] < INF:
                costs[q] = ("I" + more[0], more[1] + INSERT, more[2])
    return costs


@lru_cache(maxsize=20_000)
def _step(code, vector):
    """(least cost, vector less it, (letters, next state) a state) before a row of this code; `vector` is after it."""
    fault, initial = divmod(code, 4)
    late, options = LATE if fault == TRUNCATED else 0, []
    for q in range(4):
        own = [(DELETE + vector[q], "D", q)]
        if fault in (FINE, TRUNCATED):
            if (q, initial) in KEEP:
                own.append((late + vector[KEEP[q, initial]], "K", KEEP[q, initial]))
            own.append((REROLE + late + vector[NEXT[q]], "R", NEXT[q]))
        cost, letter, to = min(own)
        options.append((letter, cost, to))
    options = _inserts(options)
    least = min(o[1] for o in options)
    return least, tuple(o[1] - least for o in options), tuple((o[0], o[2]) for o in options)


def backward(codes, reps, vector, keep=0):
    """(cost, vector) before the first row; with `keep`, also the vectors after every keep-th row."""
    cost, kept = 0, {}
    for i in range(len(codes) - 1, -1, -1):
        if keep and (i + 1) % keep == 0:
            kept[i + 1] = vector
        least, vector, _ = _step(codes[i], vector)
        cost += least
        if reps is not None and reps[i] > 1:  # copies are all deleted
            cost += DELETE * (int(reps[i]) - 1)
    return cost, vector, kept


def walk(codes, reps, vector, state):
    """(edits, state after the last row) from `state`, given the costs after the block."""
    every = math.isqrt(len(codes)) + 1
    _, first, kept = backward(codes, reps, vector, every)
    out = []
    for low in range(0, len(codes), every):
        high = min(low + every, len(codes))
        v, steps = kept.get(high, vector), []
        for i in range(high - 1, low - 1, -1):
            _, v, choice = _step(codes[i], v)
            steps.append(choice)
        for i, choice in zip(range(low, high), reversed(steps)):
            letters, state = choice[state]
            if reps is not None and reps[i] > 1:
                at = letters.index("D")  # deletes come before inserts
                letters = letters[:at] + "D" * (int(reps[i]) - 1) + letters[at:]
            out.append(letters)
    return "".join(out), state


def shape(vector):
    least = min(vector)
    return least, tuple(v - least for v in vector)


def finish(state):
    """The inserts after the last row."""
    return "I" * (END[state] // INSERT)


def repair(codes, reps=None):
    """(cost, edits) of a whole conversation."""
    least, vector = shape(END)
    cost, first, _ = backward(codes, reps, vector)
    edits, state = walk(codes, reps, vector, 0)
    return int(cost + least + first[0]), edits + finish(state)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, lives: 0 for a dropped row, 2 for a repeated one."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key.cast("binary")) % 20).alias("how"))
    how, text = F.col("how"), F.col("text")
    changed = F.when(how <= 1, "").when(how == 2, F.translate(text, ".!?", "")).otherwise(text)
    return rows.select("conv_id", "turn", F.when(how == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("lives"))


def records(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, code, reps of rows (.., text, lives); equal rows are one, duplicates are told."""
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    small = rows.where("lives > 0").select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), fault.alias("fault"), "lives")
    small = small.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("lives").alias("reps"))
    first = small.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.isnotnull("turn"), "turn")).alias("first")).withColumnsRenamed({"conv_id": "c", "role": "r", "digest": "d"})
    same = small.conv_id.eqNullSafe(first.c) & (small.role == first.r) & (small.digest == first.d)
    told = small.join(first, same).withColumn("again", ~F.col("first.turn").eqNullSafe(F.col("turn")))
    initial = F.coalesce(F.array_position(F.lit(list(INITIALS)), F.substring("role", 1, 1)) - 1, F.lit(-1))
    initial = F.when(initial < 0, OTHER).otherwise(initial)
    code = F.when((F.col("fault") != BLANK) & F.col("again"), DUPLICATE).otherwise(F.col("fault")) * 4 + initial
    return told.select("conv_id", "turn", "role", "digest", code.cast("int").alias("code"), "reps")


BLOCKS = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("whole", pa.bool_()), ("cost", pa.int64()), ("audit", pa.string()), ("codes", pa.binary()), ("reps", pa.binary()),
    ("matrix", pa.list_(pa.float64())), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64())])
BLOCK_TYPES = "conv_id long, seq long, whole boolean, cost long, audit string, codes binary, reps binary, matrix array<double>, blank long, duplicate long, truncated long"


def _block(conv, seq, codes, reps, whole):
    codes, reps = np.concatenate(codes), np.concatenate(reps)
    faults = np.bincount(codes // 4, weights=reps, minlength=4).astype(int).tolist()
    row = {"conv_id": conv, "seq": seq, "whole": whole, "blank": faults[BLANK], "duplicate": faults[DUPLICATE], "truncated": faults[TRUNCATED]}
    plain = None if reps.max() == 1 else reps
    if whole:
        row["cost"], row["audit"] = repair(codes.tolist(), plain)
    else:
        ends = [backward(codes.tolist(), plain, tuple(0.0 if q == r else INF for q in range(4))) for r in range(4)]
        row |= {"codes": codes.astype(np.uint8).tobytes(), "reps": reps.astype("<i8").tobytes(), "matrix": [float(cost + v) for cost, vector, _ in ends for v in vector]}
    return row


def _cut(most):
    def run(batches):
        part, conv, codes, reps, held, seq, out = TaskContext.get().partitionId() << 40, None, [], [], 0, 0, []
        first = True  # the run at hand is the partition's first, or does not begin at its own first row
        for b in batches:
            names, code, rep = b["conv_id"].to_pylist(), b["code"].to_numpy(zero_copy_only=False).astype(np.int64), b["reps"].to_numpy(zero_copy_only=False)
            copies = rep > 1
            if copies.any():  # the first of equal rows may stay, the others are its duplicates
                at = np.repeat(np.arange(len(rep)), 1 + copies)
                second = np.concatenate([[False], at[1:] == at[:-1]])
                fault = np.where(second & (code[at] // 4 != BLANK), DUPLICATE, code[at] // 4)
                code, rep, names = fault * 4 + code[at] % 4, np.where(second, rep[at] - 1, 1), [names[i] for i in at]
            low = 0
            while low < len(names):
                if held and names[low] != conv:
                    out.append(_block(conv, part + seq, codes, reps, not first))
                    codes, reps, held, seq, first = [], [], 0, seq + 1, False
                conv, high = names[low], low
                while high < len(names) and held + high - low < most and names[high] == conv:
                    high += 1
                codes.append(code[low:high])
                reps.append(rep[low:high])
                held, low = held + high - low, high
                if held == most:
                    out.append(_block(conv, part + seq, codes, reps, False))
                    codes, reps, held, seq, first = [], [], 0, seq + 1, True
            yield pa.RecordBatch.from_pylist(out, BLOCKS)
            out = []
        if held:
            yield pa.RecordBatch.from_pylist([_block(conv, part + seq, codes, reps, False)], BLOCKS)

    return run


def blocks(small: DataFrame, most: int = 65_536) -> DataFrame:
    """Blocks of records in order of (conv_id, turn, role, digest), repaired where a block is a whole conversation."""
    spark, base = small.sparkSession, shared_dir(small.sparkSession)
    small.write.parquet(f"{base}/records")  # so that the bounds of the ranges hold in every attempt
    order = [F.asc(c) for c in ("conv_id", "turn", "role", "digest")]
    rows = spark.read.parquet(f"{base}/records").repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "code", "reps")
    rows.mapInArrow(_cut(most), BLOCK_TYPES).write.parquet(f"{base}/blocks")
    return spark.read.parquet(f"{base}/blocks")


def edits(cut: DataFrame) -> DataFrame:
    """conv_id, cost, audit, blank, duplicate, truncated a conversation."""
    counts = ["blank", "duplicate", "truncated"]
    whole, parts = cut.where("whole").select("conv_id", "cost", "audit", *counts), cut.where("NOT whole")

    def back(group):  # the vector after each block, from the last to the first
        group = group.sort_values("seq", ascending=False)
        (least, vector), after, total = shape(END), [], 0
        for m in group.matrix:
            after.append([float(v) for v in vector])
            total += least
            least, vector = shape([min(m[4 * r + q] + vector[r] for r in range(4)) for q in range(4)])
        return pd.DataFrame({"seq": group.seq, "after": after, "total": int(total + least + vector[0])})

    def leave(batches):  # the exit for each entry
        for b in batches:
            yield pd.DataFrame({"seq": b.seq, "exits": [[walk(list(c), np.frombuffer(n, "<i8"), tuple(v), q)[1] for q in range(4)] for c, n, v in zip(b.codes, b.reps, b.after)]})

    def enter(group):  # the entry of each block, from the first to the last
        group, state, entries = group.sort_values("seq"), 0, []
        for e in group.exits:
            entries.append(state)
            state = int(e[state])
        return pd.DataFrame({"seq": group.seq, "entry": entries, "last": [""] * (len(entries) - 1) + [finish(state)]})

    def tell(batches):
        for b in batches:
            yield pd.DataFrame({"seq": b.seq, "piece": [walk(list(c), np.frombuffer(n, "<i8"), tuple(v), q)[0] + e for c, n, v, q, e in zip(b.codes, b.reps, b.after, b.entry, b["last"])]})

    spark, base = cut.sparkSession, shared_dir(cut.sparkSession)
    after = parts.select("conv_id", "seq", "matrix").groupBy("conv_id").applyInPandas(back, "seq long, after array<double>, total long")
    parts.drop("cost", "audit", "matrix").join(after, "seq").write.parquet(base)
    known = spark.read.parquet(base)
    exits = known.select("seq", "codes", "reps", "after").mapInPandas(leave, "seq long, exits array<int>").join(known.select("conv_id", "seq"), "seq")
    entries = exits.groupBy("conv_id").applyInPandas(enter, "seq long, entry int, last string")
    pieces = known.select("seq", "codes", "reps", "after").join(entries, "seq").mapInPandas(tell, "seq long, piece string")
    audit = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda p: p.piece))
    return whole.unionByName(known.join(pieces, "seq").groupBy("conv_id").agg(F.first("total").alias("cost"), audit.alias("audit"), *[F.sum(c).alias(c) for c in counts]))


class _Reader:
    """One conversation as it streams by behind its edits: turn gaps, illegal pairs, and its repaired rows to `put`."""

    def __init__(self, conv, put):
        self.conv, self.put, self.head, self.edits, self.at, self.state = conv, put, (0, 0, 0, 0), "", 0, 0
        self.least = self.turn = self.initial = None
        self.turns = self.illegal = 0

    def insert(self):
        while self.edits[self.at:self.at + 1] == "I":
            self.put("I", "assistant" if self.state == 2 else "user", "")
            self.state, self.at = NEXT[self.state], self.at + 1

    def row(self, turn, role, text):
        if turn is not None and turn != self.turn:
            self.least = turn if self.least is None else self.least
            self.turn, self.turns = turn, self.turns + 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        self.insert()
        edit, self.at = self.edits[self.at], self.at + 1
        if edit == "K":
            self.put("K", role, text)
            self.state = KEEP[self.state, INITIALS.index(role[0])]
        elif edit == "R":
            self.put("R", "assistant" if self.state == 2 else "user", text)
            self.state = NEXT[self.state]

    def gaps(self):
        return 0 if self.least is None else self.turn - self.least + 1 - self.turns


def _streamed(turns, lives):
    """The rows of each conversation in order, in one partition, behind a row of kind 0 with its edits."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.lit(1) if lives is None else lives).alias("lives"))
    audits = edits(blocks(records(rows)))
    digest = F.unhex(F.md5("text"))
    texts = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", digest.alias("digest"), F.when(F.col("lives") > 0, F.col("text")).alias("text"), "lives", F.lit(None).cast("array<long>").alias("head"))
    heads = audits.select("conv_id", F.lit(0), F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("binary"), "audit", F.lit(1), F.array("cost", "blank", "duplicate", "truncated"))
    rows = texts.union(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return rows.select("conv_id", "kind", "turn", "role", "text", "lives", "head")


def _read(batches, begin, end):
    """Calls begin(conv) for a put function and end(reader) around every conversation; yields at the end of each batch."""
    now = None
    for b in batches:
        for conv, kind, turn, role, text, lives, head in zip(*[c.to_pylist() for c in b.columns]):
            if now is None or conv != now.conv:
                if now is not None:
                    now.insert()
                    end(now)
                now = _Reader(conv, begin(conv))
            if kind == 0:
                now.head, now.edits = head, text
            else:
                for _ in range(lives):
                    now.row(turn, role, text)
        yield
    if now is not None:
        now.insert()
        end(now)
    yield


def repaired_turns(turns: DataFrame, lives=None) -> DataFrame:
    """conv_id, place, edit, role, text: the rows that stay, in order of `place` from 0; `lives` is how often a row counts."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        out = []

        def begin(conv):
            at = iter(range(1 << 62))
            return lambda edit, role, text: out.append({"conv_id": conv, "place": next(at), "edit": edit, "role": role, "text": text})

        for _ in _read(batches, begin, lambda now: None):
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()

    return _streamed(turns, lives).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def reports(turns: DataFrame, lives=None) -> DataFrame:
    """One row a conversation: faults, cost, edits, and the SHA-256 of its repaired rows `role:text`, one a line."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([*[(n, pa.int64()) for n in names], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        out, sha = [], None

        def begin(conv):
            nonlocal sha
            sha, sep = hashlib.sha256(), iter([b""])
            return lambda edit, role, text: sha.update(next(sep, b"\n") + f"{role}:{text}".encode("utf-8", "replace"))

        def end(now):
            cost, blank, duplicate, truncated = now.head
            out.append(dict(zip(schema.names, (now.conv, now.gaps(), blank, duplicate, truncated, now.illegal, cost, now.edits, sha.hexdigest()))))

        for _ in _read(batches, begin, end):
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()

    return _streamed(turns, lives).mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", audit string, repaired_sha256 string")


def op12_structure_repair(spark, sf_dir) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return reports(rows, F.col("lives"))
