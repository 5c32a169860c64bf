"""Media columns: interleaved sequences of text and media references, resolved by digest.

HTML becomes an ordered array of items (pos, kind, text, digest, caption): kind `text` has text, kind `media`
the digest of its payload and the figure's caption (or the alt text). `resolve` joins media facts by digest and
keeps position and caption; a digest that no media row has stays with null facts. Digests that hold over
1/1000 of all references are joined by broadcast (there are at most 1000 of them), the others by a shuffle.
Null or empty text is a payload of padding only; null HTML is an empty sequence. Repeated rows keep their rows,
equal payloads are described once. Further columns are ignored.
"""

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import shared_dir

WIDTH = 576
ITEMS = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
FACTS = "n_samples long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
BREAKS = set("p div section article h1 h2 h3 h4 h5 h6 li ul ol figure figcaption table tr td br hr blockquote pre body".split())


def encode(data: bytes) -> bytes:
    """A binary grey map of WIDTH samples a row, padded with 255."""
    rows = max(1, -(-len(data) // WIDTH))
    return b"P5\n%d %d\n255\n" % (WIDTH, rows) + data.ljust(rows * WIDTH, b"\xff")


def decode(media: bytes) -> bytes:
    _, size, _, samples = media.split(b"\n", 3)
    w, h = map(int, size.split())
    if len(samples) != w * h:
        raise ValueError("samples do not fill the grey map")
    return samples


def feature(samples: bytes) -> str:
    """Sum of samples and shares of 16 grey levels in parts per 10,000."""
    a = np.frombuffer(samples, np.uint8)
    h = np.bincount(a >> 4, minlength=16)
    return f"{int(a.sum(dtype=np.int64))}:" + ",".join(str(int(x) * 10_000 // len(a)) for x in h)


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.words, self.caption, self.figure, self.skip = [], [], None, None, 0

    def flush(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in BREAKS:
            self.flush()
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.caption = len(self.items)
        elif tag in ("img", "video", "audio", "source") and (a.get("src") or "").startswith("sha256:"):
            self.flush()
            self.items.append(["media", None, a["src"][7:].lower(), a.get("alt")])

    def handle_endtag(self, tag):
        if tag in BREAKS:
            self.flush()
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None and self.figure is not None:
            said = " ".join(x[1] for x in self.items[self.caption:] if x[0] == "text")
            self.items[self.caption:] = [x for x in self.items[self.caption:] if x[0] != "text"]
            for x in self.items[self.figure:]:
                if x[0] == "media":
                    x[3] = said
            self.caption = None
        elif tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def sequence(html):
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    return [(i, *x) for i, x in enumerate(p.items)]


def store(docs: DataFrame, out: str) -> DataFrame:
    """Texts as media: writes (doc_id, n_bytes, html, digest, media); html refers to the media by digest."""
    def run(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                rows = []
                for doc_id, text in zip(b.doc_id[at:at + 256], b.text[at:at + 256]):
                    data = (text or "").encode("utf-8", "replace")
                    media = encode(data)
                    digest = hashlib.sha256(media).hexdigest()
                    rows.append((doc_id, len(data), f'<figure><img src="sha256:{digest}"><figcaption>{len(data)} bytes</figcaption></figure>', digest, media))
                yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "html", "digest", "media"]).astype({"doc_id": "Int64"})

    docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_bytes long, html string, digest string, media binary").write.parquet(out)
    return docs.sparkSession.read.parquet(out)


def describe(media: DataFrame) -> DataFrame:
    """(digest, n, facts) of each distinct payload, from its stored bytes; n is the number of its rows."""
    def run(batches):
        for b in batches:
            rows = []
            for digest, m in zip(b.digest, b.media):
                s = decode(m)
                rows.append((digest, len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(s)))
            yield pd.DataFrame(rows, columns=["digest", *(x.split()[0] for x in FACTS.split(", "))])

    names = [x.split()[0] for x in FACTS.split(", ")]
    facts = media.select("digest", "media").mapInPandas(run, "digest string, " + FACTS)
    return facts.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(*names)).alias("facts"))


def sequences(pages: DataFrame, html: str = "html") -> DataFrame:
    @F.pandas_udf(ITEMS)
    def items(h: pd.Series) -> pd.Series:
        return h.map(lambda x: [dict(zip(("pos", "kind", "text", "digest", "caption"), i)) for i in sequence(x)])

    return pages.withColumn("items", items(F.col(html)))


def resolve(seqs: DataFrame, described: DataFrame) -> DataFrame:
    """One row per item of `seqs`, with its facts where the digest is known."""
    items = seqs.withColumn("item", F.explode_outer("items")).drop("items").select("*", F.col("item.digest").alias("wanted"))
    total = described.agg(F.sum("n")).first()[0] or 0
    hot = described.where(F.col("n") > total / 1000).select(F.col("digest").alias("wanted"), F.col("facts").alias("hot_facts"))
    met = items.join(F.broadcast(hot), "wanted", "left")
    spread = F.concat(F.lit("-"), F.xxhash64(*[c for c in seqs.columns if c != "items"]).cast("string"))
    met = met.withColumn("key", F.when(F.col("hot_facts").isNotNull() | F.col("wanted").isNull(), spread).otherwise(F.col("wanted")))
    rest = described.where(F.col("n") <= total / 1000).select(F.col("digest").alias("key"), F.col("facts").alias("cold_facts"))
    return met.join(rest, "key", "left").withColumn("facts", F.coalesce("hot_facts", "cold_facts")).drop("key", "wanted", "hot_facts", "cold_facts")


def op1_media_columns(spark, sf_dir) -> DataFrame:
    stored = store(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark))
    described = describe(stored).checkpoint()
    out = resolve(sequences(stored.select("doc_id", "n_bytes", "html")).drop("html"), described)
    f = F.col("facts")
    return out.select("doc_id", "n_bytes", f.n_samples.alias("payload_bytes"), f.payload_sha256.alias("payload_sha256"), f.tail_crc32.alias("tail_crc32"),
        f.media_bytes.alias("media_bytes"), f.media_sha256.alias("media_sha256"), f.feature.alias("feature"), F.col("item.caption").alias("caption"))
