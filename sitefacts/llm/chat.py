"""Chat formatting: a finite-state machine over roles and a declarative template.

Null role and text count as empty. Rows are ordered by (turn, role, text), so ties and repeated rows have
one order; all of them are formatted. `valid` tells whether the machine accepts the role order. An unknown
role is formatted without loss and makes the conversation invalid. Further columns are ignored. A
conversation is one training example and so one row of the result. A null conv_id is a conversation; an empty table
has none.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = {
    "open": ("### ", ":\n"), "close": "</turn>\n", "loss": ["assistant"],
    # Every backslash of an escaped text is followed by one of these digits, so plain replacement reverses it.
    "escapes": [("\\", "\\0"), ("###", "\\1"), ("</turn>", "\\2"), (":", "\\3"), ("\n", "\\4")],
    "start": "start", "accept": ["user", "assistant"],
    "moves": {"start>system": "system", "start>user": "user", "system>user": "user", "user>assistant": "assistant", "assistant>user": "user"},
}


def _replace(col: Column, pairs) -> Column:
    for a, b in pairs:
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def format_conversations(turns: DataFrame, t: dict = TEMPLATE) -> DataFrame:
    """One row per conv_id: formatted, segments (text, loss) that concatenate to it, valid."""
    esc = lambda c: _replace(c, t["escapes"])
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        part(F.concat(F.lit(t["open"][0]), esc(x.role), F.lit(t["open"][1])), F.lit(False)),
        part(esc(x.text), x.role.isin(t["loss"])), part(F.lit(t["close"]), F.lit(False)))))
    moves = F.create_map(*[F.lit(v) for kv in t["moves"].items() for v in kv])
    state = F.aggregate("turns", F.lit(t["start"]), lambda s, x: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit(">"), x.role)), F.lit("reject")))
    out = rows.select("conv_id", segments.alias("segments"), state.isin(t["accept"]).alias("valid"))
    return out.withColumn("formatted", F.concat_ws("", F.transform("segments", lambda s: s.text)))


def read_back(out: DataFrame, t: dict = TEMPLATE) -> DataFrame:
    """Turns parsed from `formatted`, and the text under the loss mask, both unescaped."""
    un = lambda c: _replace(c, [(b, a) for a, b in reversed(t["escapes"])])
    chunks = F.slice(F.split("formatted", t["close"]), 1, F.size(F.split("formatted", t["close"])) - 1)
    turn = F.transform(chunks, lambda c: F.struct(
        un(F.substr(F.split_part(c, F.lit(t["open"][1]), F.lit(1)), F.lit(len(t["open"][0]) + 1))).alias("role"),
        un(F.split_part(c, F.lit(t["open"][1]), F.lit(2))).alias("text")))
    loss = F.concat_ws("", F.transform(F.filter("segments", lambda s: s.loss), lambda s: un(s.text)))
    return out.withColumn("turns", turn).withColumn("loss_text", loss)


def op2_chat_formatting(spark, sf_dir) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(extra))
    back = read_back(format_conversations(turns.union(own)))
    text = F.concat_ws("", F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "valid")


_ESC = "coalesce({0},'')"
for _a, _b in TEMPLATE["escapes"]:
    _ESC = f"replace({_ESC}, " + ("chr(10)" if _a == "\n" else f"'{_a}'") + f", '{_b}')"
ORACLE = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length({_ESC.format('role')}) + length({_ESC.format('text')})) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(role, chr(10) ORDER BY turn, role, text), '(system\n)?user(\nassistant\nuser)*(\nassistant)?') AS valid FROM t GROUP BY conv_id"""
