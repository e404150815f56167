"""Document fingerprints as a homomorphic multiset hash of paragraphs.

Each paragraph is hashed to a wide vector and a document's fingerprint is the sum of the vectors of its
paragraphs: the order of paragraphs does not matter, and paragraphs can be inserted into and deleted from a
fingerprint without the rest of the text.

A vector has two parts. EQUAL lanes modulo 2**64 are independent hashes of the paragraph's bytes; they tell
multisets of paragraphs apart. LIKE lanes modulo 2**64 (written modulo 2**16) hold, for each run of SHINGLE words of the paragraph,
+1 or -1 by a hash; the likeness of two documents is one less the squared distance of these lanes over the
sum of their squared lengths, an estimate of the share of runs they have in common.

A paragraph is a line together with its line end, so that no text is left out. A null text counts as empty;
an empty text has no paragraph and the zero fingerprint, like another empty text it has likeness 1, unlike
others 0. The next document follows in the order of doc_id (nulls first), then of a hash of the text; repeated
rows follow each other. Of a table with one row, the document is its own next one. An empty table gives no rows.
Columns other than doc_id and text are not looked at. A text of any length is read paragraph by paragraph.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm.common import documents, text_or_empty
from ionloom.llm.shingles import mix, run_hashes, word_hashes

EQUAL = 8
LIKE = 256
SHINGLE = 2
#: Rows of one chunk of the order.
CHUNK_ROWS = 1_000
MAX_CHUNKS = 100_000


def paragraphs(text: str) -> list[str]:
    """The lines of a text with their line ends; joined they are the text."""
    parts = text.split("\n")
    lines = [p + "\n" for p in parts[:-1]]
    return lines + [parts[-1]] if parts[-1] else lines


@cache
def _places() -> np.ndarray:
    return mix(np.arange(1, LIKE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Fingerprint:
    """The sum of the vectors of a multiset of paragraphs."""

    __slots__ = ("equal", "like")

    def __init__(self, equal: np.ndarray | None = None, like: np.ndarray | None = None):
        self.equal = np.zeros(EQUAL, np.uint64) if equal is None else equal
        self.like = np.zeros(LIKE, np.int64) if like is None else like

    def _change(self, lines: list[str], sign: int) -> Fingerprint:
        equal, like = self.equal.copy(), self.like.copy()
        if lines:
            raw = [line.encode("utf-8", "surrogatepass") for line in lines]
            hashes = np.array([xxhash.xxh3_128_intdigest(r) & (2**64 - 1) for r in raw], np.uint64)
            tags = np.array([xxhash.xxh64_intdigest(r, 7) for r in raw], np.uint64)
            lanes = np.arange(1, EQUAL + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
            own = mix(hashes[:, None] * (lanes | np.uint64(1)) + mix(tags)[:, None]).sum(0, dtype=np.uint64)
            equal = equal + own if sign > 0 else equal - own
            words = [r.split() for r in raw]
            sizes = [len(w) for w in words]
            flat = word_hashes([w for own in words for w in own])
            runs, at = [], 0
            for n in sizes:
                if n:
                    runs.append(run_hashes(flat[at : at + n], min(SHINGLE, n)))
                at += n
            if runs:
                own = np.concatenate(runs)
                ones = np.zeros(LIKE, np.int64)
                for low in range(0, len(own), 4096):
                    bits = mix(own[low : low + 4096, None] ^ _places())
                    ones += np.unpackbits(bits.view(np.uint8), axis=1).sum(0, dtype=np.int64)
                like += sign * (2 * ones - len(own))
        return Fingerprint(equal, like)

    def insert(self, lines: list[str]) -> Fingerprint:
        return self._change(lines, 1)

    def delete(self, lines: list[str]) -> Fingerprint:
        return self._change(lines, -1)

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        return cls().insert(paragraphs(text))

    def hex(self) -> str:
        return self.equal.tobytes().hex() + self.like.astype(np.int16).tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        a, b = self.like.astype(np.float64), other.like.astype(np.float64)
        norm = a @ a + b @ b
        if norm == 0:
            return float((self.equal == other.equal).all())
        return float(np.clip(1 - ((a - b) @ (a - b)) / norm, 0, 1))


def replace_end(text: str, following: str) -> tuple[str, list[str], list[str]]:
    """The text with its last half replaced by the start of another, and the paragraphs this deletes and inserts."""
    half = len(text) // 2
    if not half:
        return text, [], []
    cut = len(text) - half
    start = text.rfind("\n", 0, cut) + 1  # of the paragraph in which the cut lies
    new = text[:cut] + following[:half]
    return new, paragraphs(text[start:]), paragraphs(new[start:])


def _chunk(cuts: list[int]):
    """How many of the ascending `cuts` are at most doc_id, by halving."""
    if not cuts:
        return F.lit(0)
    table = F.array(*map(F.lit, cuts)) if len(cuts) < 100 else F.from_json(F.lit(str(cuts)), "array<bigint>")
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        upper = F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))
        lower = F.struct(s["lo"].alias("lo"), mid.alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(F.get(table, mid) <= F.col("doc_id"), upper).otherwise(lower)

    steps = F.sequence(F.lit(0), F.lit(len(cuts).bit_length()))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(F.aggregate(steps, start, halve, lambda s: s["lo"]))


def with_next(docs: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(chunk, lead, doc_id, order, text) dealt by chunk and sorted, so that every row's next one comes behind it.

    doc_ids are cut into chunks at approximate quantiles, MAX_CHUNKS at most, beyond which chunks get longer;
    a task only ever holds two rows of one. The first row of a chunk is also sent, as `lead`, to the end of the
    chunk before it, and the first of all to the last chunk. The driver sees one row per chunk.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    n = min(MAX_CHUNKS, max(1, rows.count() // chunk_rows))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 4 * n)).alias("cuts")).head()["cuts"] if n > 1 else []
    keyed = rows.withColumn("order", F.xxhash64("text")).withColumn("chunk", _chunk(sorted(set(cuts or []))).cast("int"))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "order")).alias("head")
    heads = sorted((r["chunk"], r["head"]["doc_id"], r["head"]["order"]) for r in keyed.groupBy("chunk").agg(first).collect())
    before = [(c, d, o, heads[i - 1][0]) for i, (c, d, o) in enumerate(heads)]
    table = F.broadcast(docs.sparkSession.createDataFrame(before, "hc int, hd long, ho long, into int"))
    is_head = (F.col("chunk") == F.col("hc")) & F.col("doc_id").eqNullSafe(F.col("hd")) & (F.col("order") == F.col("ho"))
    own = F.struct("chunk", F.lit(0).alias("lead"))
    places = F.when(F.col("into").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("into").alias("chunk"), F.lit(1).alias("lead"))))
    dealt = keyed.join(table, is_head, "left").select(F.explode(places).alias("p"), "doc_id", "order", "text")
    dealt = dealt.select("p.chunk", "p.lead", "doc_id", "order", "text")
    return dealt.repartition("chunk").sortWithinPartitions("chunk", "lead", F.asc_nulls_first("doc_id"), "order")


def fingerprint_report(docs: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per row of `docs`: the fingerprints of its text and its edited text, and how alike they and the next text's are."""
    kinds = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for chunk, lead, doc_id, text in zip(*(batch.column(i) for i in range(4))):
                chunk, lead, doc_id, text = chunk.as_py(), lead.as_py(), doc_id.as_py(), text.as_py()
                own = Fingerprint.of(text)
                if last and last[0] == chunk:
                    _, before_id, before, print_ = last
                    new, deleted, inserted = replace_end(before, text)
                    edited = print_.delete(deleted).insert(inserted)
                    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((before_id, len(before), sha, print_.hex(), edited.hex(), print_.likeness(edited), print_.likeness(own)))
                last = None if lead else (chunk, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*out), kinds)], [n for n, _ in kinds])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, chunk_rows).select("chunk", "lead", "doc_id", "text").mapInArrow(run, schema)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(documents(spark, sf_dir))
