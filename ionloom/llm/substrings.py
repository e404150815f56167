"""Removal of repeated passages by super-k-mer partitioning.

A window is WINDOW consecutive words of one document. A word goes when a window that covers it has a word
sequence that also starts in a document with a smaller doc_id; windows are judged on the input.

The minimiser of a window is its run of MINIMISER words with the smallest hash (the leftmost of equal ones).
Consecutive windows mostly share it, and equal windows always do, so a run of such windows (a super-k-mer)
travels as one string to the bucket of its minimiser. First only the hashes are sent: a run whose minimiser
no other document has cannot repeat and stays where it is; a minimiser that a document
meets again and again is one row with all places. The words of the other runs are then packed,
equal strings of a document and then of a bucket are merged before the shuffle, and in each bucket the windows are sorted, so that
each finds the smallest doc_id that has it. Equality is decided on the words themselves.

A bucket with more than BUCKET_STRINGS different strings (a very common passage in ever new surroundings)
is cut into its windows, which are grouped as rows of their own and so spread over all tasks.

Null texts have no words; rows with a null doc_id count as larger than all others and do not repeat each
other. Rows that share a doc_id are one document that cannot repeat itself. Documents shorter than a window
lose nothing. An empty table gives no rows. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm.common import documents, heavy_keys, salted_join, sealed, text_or_empty, written
from ionloom.llm.shingles import claim_hashes, run_hashes, word_hashes

WINDOW = 50
MINIMISER = 8
#: Different strings of one bucket that are sorted in one task.
BUCKET_STRINGS = 20_000
#: Stands for a null doc_id.
LAST_ID = 2**63 - 1


def split_words(text: str | None) -> list[bytes]:
    """The runs of characters other than ASCII white space, which is how bytes are split."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def super_kmers(words: list[bytes], window: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the minimiser, first window, number of windows) of each run of windows with one minimiser."""
    n = len(words) - window + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = run_hashes(word_hashes(words), minimiser)
    width = window - minimiser + 1
    # Smallest of each stretch of `width` by doubling, with the leftmost of equal ones.
    at, span = np.arange(len(hashes)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[: len(at) - step], at[step:]
        at, span = np.where(hashes[right] < hashes[left], right, left), span + step
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return hashes[at[first]].view(np.int64), first, np.diff(np.r_[first, n])


def _doc_runs(docs: DataFrame, window: int, minimiser: int) -> DataFrame:
    """(minimiser, id, row_key, firsts, windows): one row per document and minimiser, with the first windows and the sizes of its runs.

    A document that repeats a passage has the same minimisers hundreds of times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_hashes()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = [super_kmers(split_words(text.as_py()), window, minimiser) for text in part.column(2)]
                keys, firsts, counts = (np.concatenate(x) for x in zip(*found))
                at = np.repeat(np.arange(len(found)), [len(key) for key, _, _ in found])
                order = np.lexsort((keys, at))  # keeps the order of the runs of one minimiser
                keys, at = keys[order], at[order]
                new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])][: len(keys)])
                ends = pa.array(np.r_[new, len(keys)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[order].astype(np.int32))) for x in (firsts, counts)]
                owner = pa.array(at[new])
                columns = [pa.array(keys[new]), part.column(0).take(owner), part.column(1).take(owner), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["minimiser", "id", "row_key", "firsts", "windows"])

    schema = "minimiser long, id long, row_key long, firsts array<int>, windows array<int>"
    return docs.select("id", "row_key", "text").mapInArrow(run, schema)


def _packed(suspects: DataFrame, window: int) -> DataFrame:
    """(minimiser, id, row_key, firsts, packed): the words of each run of `suspects` (id, row_key, text, runs), joined by blanks.

    Equal runs of a row, as of a passage that it repeats, are one row with the first windows of all.
    """
    schema = "minimiser long, id long, row_key long, firsts array<int>, packed binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                rows = []
                for row in batch.slice(low, 128).to_pylist():
                    words = split_words(row["text"])
                    met: dict[tuple[int, bytes], list[int]] = {}
                    for piece in row["runs"]:
                        first = piece["first"]
                        packed = b" ".join(words[first : first + piece["windows"] + window - 1])
                        met.setdefault((piece["minimiser"], packed), []).append(first)
                    rows += [(minimiser, row["id"], row["row_key"], firsts, packed) for (minimiser, packed), firsts in met.items()]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["minimiser", "id", "row_key", "firsts", "packed"])

    return suspects.select("id", "row_key", "text", "runs").mapInArrow(run, schema)


def _windows(packed: bytes, window: int) -> list[bytes]:
    """The windows of a packed string, as slices of it."""
    starts = np.flatnonzero(np.r_[True, np.frombuffer(packed, np.uint8) == 32]).tolist()
    ends = [s - 1 for s in starts[1:]] + [len(packed)]
    return [packed[starts[i] : ends[i + window - 1]] for i in range(len(starts) - window + 1)]


def _first_owners(strings: DataFrame, window: int) -> DataFrame:
    """(minimiser, packed_key, owners) of `strings` (minimiser, packed, packed_key, owner): the smallest id with each window.

    Sorted by minimiser, a partition is read bucket by bucket; a bucket is small, see BUCKET_STRINGS.
    """

    def settle(bucket: list[tuple]) -> list[tuple]:
        if len(bucket) == 1:
            minimiser, packed, key, owner = bucket[0]
            return [(minimiser, key, [owner] * (packed.count(b" ") + 2 - window))]
        windows = [_windows(packed, window) for _, packed, _, _ in bucket]
        ordered = sorted(((w, owner) for own, (_, _, _, owner) in zip(windows, bucket) for w in own), reverse=True)
        smallest = dict(ordered)  # the last of equal windows has the smallest id
        return [(minimiser, key, [smallest[w] for w in own]) for own, (minimiser, _, key, _) in zip(windows, bucket)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: list[tuple] = []
        names, kinds = ["minimiser", "packed_key", "owners"], [pa.int64(), pa.binary(), pa.list_(pa.int64())]
        made: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket and bucket[0][0] != row[0]:
                    made += settle(bucket)
                    bucket = []
                bucket.append(row)
                if len(made) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made), kinds)], names)
                    made = []
        made += settle(bucket) if bucket else []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made), kinds)], names)

    dealt = strings.select("minimiser", "packed", "packed_key", "owner").repartition("minimiser").sortWithinPartitions("minimiser")
    return dealt.mapInArrow(run, "minimiser long, packed_key binary, owners array<long>")


def _crowded_owners(strings: DataFrame, window: int) -> DataFrame:
    """The same for crowded buckets: each window is a row, equal ones are merged before and after the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                rows = [(m, key, i, owner, w) for m, packed, key, owner in zip(*(c.to_pylist() for c in batch.slice(low, 128).columns)) for i, w in enumerate(_windows(packed, window))]
                kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["minimiser", "packed_key", "at", "owner", "seen"])

    cut = strings.select("minimiser", "packed", "packed_key", "owner").mapInArrow(run, "minimiser long, packed_key binary, at int, owner long, seen binary")
    smallest = cut.groupBy("seen").agg(F.min("owner").alias("first_owner"))
    placed = cut.join(smallest, "seen").groupBy("minimiser", "packed_key").agg(F.array_sort(F.collect_list(F.struct("at", "first_owner"))).alias("o"))
    return placed.select("minimiser", "packed_key", F.col("o.first_owner").alias("owners"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, bucket_strings: int = BUCKET_STRINGS) -> tuple[DataFrame, DataFrame]:
    """(suspects, spans): rows of `docs` (id, row_key, text) that may repeat others, and (id, row_key, spans) of windows to remove.

    A span is its first window (lo) and the number of windows.
    """
    runs = written(_doc_runs(docs, window, minimiser), "runs")
    shared = runs.groupBy("minimiser").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    shared = written(shared.select("minimiser", "n"), "shared")
    heavy = heavy_keys(shared, "minimiser", runs.count())
    held = salted_join(runs, shared.select("minimiser"), "minimiser", "left_semi", heavy, F.xxhash64("id", "row_key"))
    # A set: rows with one doc_id and text have the same runs.
    held = held.groupBy("id", "row_key").agg(F.collect_set(F.struct("minimiser", "firsts", "windows")).alias("same"))

    def places(row: Column) -> Column:
        return F.transform(F.arrays_zip(row["firsts"], row["windows"]), lambda at: F.struct(row["minimiser"].alias("minimiser"), at["firsts"].alias("first"), at["windows"].alias("windows")))

    held = held.select("id", "row_key", F.flatten(F.transform("same", places)).alias("runs"))
    suspects = written(docs.select("id", "row_key", "text").join(held.hint("shuffle_hash"), ["id", "row_key"]), "suspects")

    packed = _packed(suspects, window).withColumn("packed_key", F.unhex(F.md5("packed")))
    strings = packed.groupBy("minimiser", "packed").agg(F.min("id").alias("owner"))
    strings = written(strings.withColumn("packed_key", F.unhex(F.md5("packed"))), "strings")
    crowded = written(strings.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_strings).select("minimiser"), "crowded")
    if crowded.head(1):
        few = strings.join(crowded.hint("shuffle_hash"), "minimiser", "left_anti")
        many = strings.join(crowded.hint("shuffle_hash"), "minimiser", "left_semi")
        owners = _first_owners(few, window).unionByName(_crowded_owners(many, window))
    else:
        owners = _first_owners(strings, window)
    owners = written(owners, "owners")
    placed = packed.select("minimiser", "packed_key", "id", "row_key", "firsts").join(owners.hint("shuffle_hash"), ["minimiser", "packed_key"])
    # Runs of a document are met all over the buckets: they are put together before its stretches are sought.
    gone = F.transform("owners", lambda owner: owner < F.col("id"))
    hit = placed.select("id", "row_key", "firsts", gone.alias("gone")).where(F.array_contains("gone", True))
    hit = hit.groupBy("id", "row_key").agg(F.collect_list(F.struct("firsts", "gone")).alias("runs"))
    runs = F.transform("runs", lambda run: F.transform(run["firsts"], lambda first: F.struct(first.alias("first"), run["gone"].alias("gone"))))
    return suspects, hit.select("id", "row_key", F.flatten(runs).alias("runs")).mapInArrow(_spans, "id long, row_key long, spans array<struct<lo: int, windows: int>>")


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of windows whose smallest owner comes before the document, one row per document."""
    span = pa.struct([("lo", pa.int32()), ("windows", pa.int32())])
    for batch in batches:
        found = []
        for runs in batch.column(2):
            runs = runs.as_py()
            mark = np.zeros(max(run["first"] + len(run["gone"]) for run in runs) + 2, bool)
            for run in runs:
                mark[run["first"] + 1 : run["first"] + 1 + len(run["gone"])] |= np.array(run["gone"], bool)
            edges = np.flatnonzero(mark[1:] != mark[:-1])
            found.append([{"lo": lo, "windows": hi - lo} for lo, hi in edges.reshape(-1, 2).tolist()])
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(span))], ["id", "row_key", "spans"])


def covered(n: int, spans: list[dict], window: int) -> np.ndarray:
    """Which of n words the windows of `spans` cover."""
    change = np.zeros(n + 1, np.int64)
    for span in spans:
        change[span["lo"]] += 1
        change[min(n, span["lo"] + span["windows"] - 1 + window)] -= 1
    return np.cumsum(change[:-1]) > 0


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with id (null doc_ids last) and row_key, which tells apart rows that share a doc_id."""
    return docs.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))).withColumn("row_key", F.xxhash64(text_or_empty()))


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def removal_report(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, bucket_strings: int = BUCKET_STRINGS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per row of `docs`."""
    rows = _keyed(docs.select("doc_id", "text"))
    suspects, spans = repeated_windows(rows, window, minimiser, bucket_strings)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha = [], []
            for text in batch.column(3):
                words = split_words(text.as_py())
                n.append(len(words))
                sha.append(_digest(words))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "id", "row_key", "n_words", "sha"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha = [], []
            for text, own in zip(batch.column(2), batch.column(3)):
                words = split_words(text.as_py())
                gone = covered(len(words), own.as_py(), window)
                n.append(int(gone.sum()))
                sha.append(_digest([w for w, g in zip(words, gone.tolist()) if not g]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["id", "row_key", "n_removed", "kept"])

    base = rows.select(F.col("doc_id").cast("long"), "id", "row_key", "text").mapInArrow(whole, "doc_id long, id long, row_key long, n_words long, sha string")
    cut = suspects.select("id", "row_key", "text").join(spans, ["id", "row_key"]).select("id", "row_key", "text", "spans")
    cut = written(cut.mapInArrow(rest, "id long, row_key long, n_removed long, kept string").dropDuplicates(["id", "row_key"]), "cut")
    out = base.join(cut.hint("shuffle_hash"), ["id", "row_key"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))


def substring_dedup_documents(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """`docs` without the repeated words, columns as given; the pipeline's stage.

    A removed word takes the white space after it along. n_chars is that of the new text. A document none of
    whose words are left goes; one that had no words from the start stays as it is.
    """
    rows = _keyed(sealed(docs))
    suspects, spans = repeated_windows(rows, window, minimiser)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, own in zip(batch.column(2), batch.column(3)):
                raw = text.as_py().encode("utf-8", "surrogatepass").lstrip()
                pieces = re.findall(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", raw)
                gone = covered(len(pieces), own.as_py(), window)
                texts.append(b"".join(w for w, g in zip(pieces, gone.tolist()) if not g).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["id", "row_key", "new_text"])

    cut = suspects.select("id", "row_key", "text").join(spans, ["id", "row_key"]).select("id", "row_key", "text", "spans")
    cut = written(cut.mapInArrow(rest, "id long, row_key long, new_text string").dropDuplicates(["id", "row_key"]), "cut")
    out = rows.join(cut.hint("shuffle_hash"), ["id", "row_key"], "left").where("new_text is null or new_text <> ''")
    fields = []
    for c in docs.columns:
        if c == "text":
            fields.append(F.coalesce("new_text", "text").alias("text"))
        elif c == "n_chars":
            old = F.col("_rest").getField(c)
            fields.append(F.when(F.col("new_text").isNotNull(), F.char_length("new_text")).otherwise(old).cast(docs.schema[c].dataType).alias(c))
        else:
            fields.append(F.col(c) if c == "doc_id" else F.col("_rest").getField(c).alias(c))
    return out.select(*fields)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(documents(spark, sf_dir))


OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
), gone AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS owner FROM windows) WHERE owner < doc_id
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM gone
), lists AS (SELECT doc_id, list(i) AS g, count(*) AS n FROM dropped GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(l.n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN l.n IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(l.g, k)) END, ' ')) AS kept_sha256
FROM words w LEFT JOIN lists l ON w.doc_id = l.doc_id
"""
