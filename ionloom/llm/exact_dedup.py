"""Exact dedup against immutable snapshots screened by static binary-fuse filters.

Texts are equal when they are identical after deleting every ASCII white-space character. Of equal
texts, the row with the most code points in its original text stays, then the smallest doc_id, then
one of the repeated rows.

A batch is grouped by digest. A snapshot is a batch's groups, frozen, with one filter of about nine
bits a key for each of its segments. The digests of the next batch look into the filter of their
segment; only positives join the snapshot's buckets. Every digest that more than one row has is then
checked byte by byte: its texts are grouped by digest and text, and digests with several texts (hash
collisions) are settled by text.

Nulls and empty texts are one text, the empty one, and duplicates of each other. Rows with a null
doc_id take part and lose ties. An empty table gives an empty result. Columns other than doc_id and
text are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ionloom.llm.common import documents, heavy_keys, salted_join, sealed, text_or_empty, unsealed, written

#: Digests of one segment, and so of one filter: bounds the memory of a task.
SEGMENT_KEYS = 250_000


def normalised(name: str = "text"):
    """The text without ASCII white space."""
    return F.regexp_replace(text_or_empty(name), r"[\x20\x09-\x0D]+", "")


# --- the filter ------------------------------------------------------------------------------------


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    z = keys + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@dataclass
class FuseFilter:
    """A 3-wise binary fuse filter with 8-bit fingerprints: no false negatives, 1 in 256 false positives."""

    seed: int
    segment: int
    segments: int
    table: np.ndarray

    @staticmethod
    def _slots(mixed: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """The three slots of each key, in three neighbouring segments."""
        first = ((mixed >> np.uint64(40)) * np.uint64(segments)) >> np.uint64(24)
        within = np.uint64(segment - 1)
        return np.stack([(first + np.uint64(i)) * np.uint64(segment) + ((mixed >> np.uint64(13 * i)) & within) for i in range(3)]).astype(np.int64)

    @staticmethod
    def _prints(mixed: np.ndarray) -> np.ndarray:
        return ((mixed * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(56)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Peels keys off slots that hold one key, layer by layer, then fills the slots in reverse order."""
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = min(8192, 2 ** max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        slack = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
        segments = max(1, math.ceil(n * slack / segment) - 2)
        for seed in range(1, 1000):
            if seed % 20 == 0:
                segments += 1 + segments // 20
            mixed = _mix(keys, seed)
            slots = cls._slots(mixed, segment, segments)
            load = np.zeros((segments + 2) * segment, np.int32)
            owner = np.zeros(len(load), np.int64)
            for row in slots:
                np.add.at(load, row, 1)
                np.bitwise_xor.at(owner, row, np.arange(n))
            layers, front, left = [], np.flatnonzero(load == 1), n
            while len(front):
                peeled, at = np.unique(owner[front], return_index=True)
                layers.append((peeled, front[at]))
                left -= len(peeled)
                touched = slots[:, peeled]
                for row in touched:
                    np.subtract.at(load, row, 1)
                    np.bitwise_xor.at(owner, row, peeled)
                touched = np.unique(touched)
                front = touched[load[touched] == 1]
            if left == 0:
                break
        else:
            raise RuntimeError("the filter could not be built")
        table, prints = np.zeros(len(load), np.uint8), cls._prints(mixed)
        for peeled, at in reversed(layers):
            table[at] = 0
            table[at] = prints[peeled] ^ np.bitwise_xor.reduce(table[slots[:, peeled]], axis=0)
        return cls(seed, segment, segments, table)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mixed = _mix(keys.astype(np.uint64), self.seed)
        return np.bitwise_xor.reduce(self.table[self._slots(mixed, self.segment, self.segments)], axis=0) == self._prints(mixed)


def _keys(digests: pd.Series) -> np.ndarray:
    return np.array([int.from_bytes(x[:8], "little") for x in digests], np.uint64)


# --- snapshots -------------------------------------------------------------------------------------


@dataclass
class Snapshot:
    """Frozen groups (digest, n, best) of earlier batches and a filter for each segment of their digests."""

    groups: DataFrame
    filters: DataFrame
    segments: int


def batch_groups(rows: DataFrame) -> DataFrame:
    """One row per digest: number of rows, and the row that stays. Copies are summed before the shuffle."""
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("minus_id"), (-F.col("uid")).alias("minus_uid")))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))


def _segment(segments: int):
    return F.pmod(F.xxhash64("digest"), F.lit(segments)).cast("int")


def freeze(groups: DataFrame, segments: int) -> Snapshot:
    """The snapshot of written `groups`; each segment's filter is built in one task from a bounded number of digests."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        made = FuseFilter.build(_keys(part["digest"]))
        return pd.DataFrame({"part": [part["part"].iat[0]], "seed": [made.seed], "segment": [made.segment], "segments": [made.segments], "slots": [made.table.tobytes()]})

    keyed = groups.select("digest", _segment(segments).alias("part"))
    filters = keyed.groupBy("part").applyInPandas(build, "part int, seed int, segment int, segments int, slots binary")
    return Snapshot(groups, written(filters, "fuse-filters"), segments)


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The digests of `groups` that the snapshot's filters do not rule out."""

    def probe(part: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if filters.empty or part.empty:
            return pd.DataFrame({"digest": []})
        seed, segment, segments, slots = filters[["seed", "segment", "segments", "slots"]].iloc[0]
        made = FuseFilter(int(seed), int(segment), int(segments), np.frombuffer(slots, np.uint8))
        return part.loc[made.contains(_keys(part["digest"])), ["digest"]]

    keyed = groups.select("digest", _segment(snapshot.segments).alias("part")).groupBy("part")
    return keyed.cogroup(snapshot.filters.groupBy("part")).applyInPandas(probe, "digest binary")


# --- the operator ----------------------------------------------------------------------------------


def exact_dedup(docs: DataFrame, batches: int = 2, digest_bytes: int = 32, segment_keys: int = SEGMENT_KEYS) -> DataFrame:
    """(uid, doc_id, keep_id, group_size, kept, text_sha256, digest), one row per row of `docs`.

    `docs` arrives in `batches` batches (dealt by a hash of doc_id): each is screened against the snapshots
    of those before it. `digest_bytes` below 32 forces collisions in tests; results do not depend on it.
    """
    spark = docs.sparkSession
    sha = F.sha2(normalised(), 256)
    digest = F.substring(F.unhex(sha), 1, digest_bytes)
    texts = docs.select("doc_id", normalised().alias("norm"), digest.alias("digest"))
    count = Observation()
    light = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.char_length(text_or_empty()).cast("long").alias("n_chars"),
        digest.alias("digest"), *([] if digest_bytes == 32 else [F.unhex(sha).alias("sha")]),
        F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"),
    )
    rows = written(light.observe(count, F.count(F.lit(1)).alias("rows")), "digests")
    total = count.get["rows"] if rows.head(1) else 0
    segments = max(1, math.ceil(total / batches / segment_keys))

    merged, snapshots = None, []
    repeated = None
    for number in range(batches):
        groups = written(batch_groups(rows.where(F.col("batch") == number)), "groups")
        again = groups.where("n > 1").select("digest")
        for old in snapshots:
            again = again.unionByName(screen(groups, old).join(old.groups.select("digest"), "digest", "left_semi"))
        repeated = again if repeated is None else repeated.unionByName(again)
        merged = groups if merged is None else merged.unionByName(groups)
        if number + 1 < batches:
            snapshots.append(freeze(groups, segments))
    repeated = repeated.distinct()
    merged = merged.join(repeated, "digest", "left_semi").groupBy("digest").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    merged = written(merged, "repeated")

    heavy = heavy_keys(merged, "digest", total)
    salt = F.xxhash64("doc_id")
    suspects = salted_join(texts, merged.select("digest"), "digest", "left_semi", heavy, salt)
    classes = suspects.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))
    clashes = written(classes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "clashes")
    alike = merged.select("digest", F.col("n").alias("group_size"), (-F.col("best.minus_id")).alias("keep_id"), (-F.col("best.minus_uid")).alias("keep_uid"))
    if clashes.head(1):
        return _by_text(docs, rows, alike, clashes, digest)
    out = salted_join(rows, alike, "digest", "left", heavy, F.xxhash64("uid"))
    return _result(out)


def _result(out: DataFrame) -> DataFrame:
    kept = F.coalesce(F.col("keep_uid") == F.col("uid"), F.lit(True))
    alone = F.col("group_size").isNull()
    sha = F.col("sha") if "sha" in out.columns else F.col("digest")
    return out.select(
        "uid", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex(sha)).alias("text_sha256"), "digest",
    )


def _by_text(docs: DataFrame, rows: DataFrame, alike: DataFrame, clashes: DataFrame, digest) -> DataFrame:
    """The result when different texts share a digest: those digests are settled by their texts."""
    plain = rows.join(clashes, "digest", "left_anti").join(alike, "digest", "left")
    texts = docs.select(F.col("doc_id").cast("long"), normalised().alias("norm"), F.char_length(text_or_empty()).cast("long").alias("n_chars"), digest.alias("digest"))
    texts = texts.join(clashes, "digest", "left_semi")
    # Rows alike in doc_id, length and text are interchangeable: they take the uids of their digest in any order.
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("minus_id"))).alias("best")
    classes = texts.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("group_size"), best)
    placed = texts.join(classes, ["digest", "norm"])
    sha = F.unhex(F.sha2("norm", 256))
    settled = placed.groupBy("doc_id", "n_chars", "norm", "digest", "group_size", "best").agg(F.count(F.lit(1)).alias("copies"))
    settled = settled.select(
        F.posexplode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy", "_one"), "doc_id", sha.alias("sha"), "digest", "group_size",
        (-F.col("best.minus_id")).alias("keep_id"), (F.col("best.n_chars") == F.col("n_chars")).alias("longest"),
    )
    keeps = F.col("longest") & F.col("keep_id").eqNullSafe(F.col("doc_id")) & (F.col("copy") == 0)
    settled = settled.select(
        F.lit(None).cast("long").alias("uid"), "doc_id", "keep_id", "group_size", keeps.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "digest"
    )
    return _result(plain).unionByName(settled)


def dedup_documents(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that an equal text displaces, columns as given; the pipeline's stage.

    One row of each group of equal texts stays, also if several have the same doc_id or none.
    """
    gone = written(exact_dedup(docs).where("not kept").select("doc_id", F.col("digest").alias("_digest"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("same")), "gone")
    marked = sealed(docs).withColumn("_digest", F.unhex(F.sha2(normalised(), 256)))
    losers = gone.where("not same").select(F.col("doc_id").alias("_id"), F.col("_digest").alias("_d")).distinct()
    left = marked.join(losers, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_d")), "left_anti")
    if gone.where("same").head(1):  # several rows of one doc_id: the longest original stays, by a rule that a rerun task repeats
        first = Window.partitionBy("doc_id", "_digest").orderBy(F.desc(F.char_length(text_or_empty())), F.xxhash64("text"), F.xxhash64("_rest"))
        left = left.withColumn("_place", F.row_number().over(first)).where("_place = 1")
    return unsealed(left, docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
