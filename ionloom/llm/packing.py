"""Best-fit packing of token sequences by large-item matching.

Documents are tokenised whole and cut into pieces of at most `capacity` tokens. Pieces above a third of the
capacity are large: at most two share a sequence, and the longest is matched greedily with the longest
that still fits. The smaller ones, longest first, go into the tightest remaining gap.

The plan needs only how many pieces there are of each length, a table of at most `capacity` rows whatever
the input: bins alike are handled as one class, and a class of bins takes pieces of a length in one step. The
plan gives runs of ranks per length; every piece looks up its rank among the pieces of its length.

A null text counts as empty: its document is the closing id alone. Repeated rows are packed once each, so a
doc_id may occur more than once. An empty table gives no rows. Further columns are not looked at.
"""

from __future__ import annotations

import math
import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionloom.llm.common import claim_caches, documents, text_or_empty, text_slices, written

CAPACITY = 4096
END_ID = 1
#: Words of one of the two generations whose ids a worker keeps, some 20 MB; only memory and speed depend on it.
CACHED_WORDS = 100_000
#: Bytes of text that are split together.
SLICE = 4 << 20
#: A letter, a run of marks after it, and the blank or end behind.
_MARKED = r"(\pL)([.,;:!?*$%&#]+)( |$)"
_WORD_END = "</w>"
#: Pieces of one length that are ranked in one task.
RANK_ROWS = 500_000


# --- tokens ----------------------------------------------------------------------------------------


class WordIds:
    """Ids of texts, word by word.

    The vocabulary's tokens never cross blanks or line ends and drop them, so the ids of a text are those of
    its blank-separated words one after the other. The words of many texts are dictionary-encoded, looked up once each, and
    put together by position. Words are remembered in two generations of CACHED_WORDS: a full young one becomes
    the old one, and words met again are taken over from there, so frequent words stay and memory is bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[number for token, number in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the 32-bit ids of all texts, and where each text's begin and end."""
        # The vocabulary puts all in lower case; doing it first for plain ASCII makes more words alike. Texts that may hold
        # special strings, which have a case, stay as they are. Marks after a letter have ids of their own.
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        words = pc.split_pattern(pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), _MARKED, r"\1 \2\3"), " ")
        encoded = words.flatten().dictionary_encode()
        names, at = encoded.dictionary.to_pylist(), encoded.indices.to_numpy()
        if len(self.young) > CACHED_WORDS:
            self.young, self.old = {}, self.young
        young = self.young
        self._learn([name for name in names if name not in young])
        known = [young[name] for name in names]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool, first = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes
        count = sizes[at]
        ends = np.cumsum(count)
        ids = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[at] - (ends - count), count)]
        return ids, np.r_[0, ends][words.offsets.to_numpy() - words.offsets[0].as_py()]

    def _learn(self, fresh: list[str]) -> None:
        """Puts the ids of these words into the young generation."""
        young, old, unknown = self.young, self.old, []
        for word in fresh:
            ids = old.get(word)
            if ids is None:
                unknown.append(word)
            else:
                young[word] = ids
        self._encode(unknown)

    def _encode(self, words: list[str]) -> None:
        """Tokenises words. Those of letters alone have one token that ends a word, their last, so many go through as one text."""
        young, plain, others = self.young, [], []
        for word in words:
            alike = word.isalpha() and (word.isascii() or (unicodedata.is_normalized("NFC", word) and word.lower().isalpha()))
            (plain if alike else others).append(word)
        joined = [plain[low : low + 256] for low in range(0, len(plain), 256)]
        for own, made in zip(joined, self.tokenizer.encode_batch_fast([" ".join(x) for x in joined], add_special_tokens=False) if joined else ()):
            ids = np.array(made.ids, "<u4")
            borders = np.flatnonzero(self.ends[ids]) + 1
            if len(borders) != len(own) or borders[-1] != len(ids):
                others += own
                continue
            raw, low = ids.tobytes(), 0
            for word, high in zip(own, (4 * borders).tolist()):
                young[word] = raw[low:high]
                low = high
        for word, made in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False) if others else ()):
            young[word] = np.array(made.ids, "<u4").tobytes()


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of whole documents cut at every `capacity` tokens."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.binary())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_ids(vocabulary), np.array([end_id], "<u4").tobytes()
        claim_caches("word ids", encoder.clear)
        for batch in batches:
            for part in text_slices(batch, 1, SLICE):
                rows, (flat, offsets) = [], encoder.of(part.column(1))
                for doc_id, low, high in zip(part.column(0).to_pylist(), offsets, offsets[1:]):
                    ids = flat[low:high].tobytes() + end
                    for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((doc_id, number, at // 4, len(own) // 4, zlib.crc32(own), own)[: len(fields)])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, schema)


# --- the plan --------------------------------------------------------------------------------------


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first bin, pieces a bin, place in the bin) that pack all pieces.

    Pieces of a run fill its bins one bin after the other. The work grows with the number of different
    lengths, not with the number of pieces.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    done = dict.fromkeys(counts, 0)
    left = dict(counts)
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> classes (first bin, bins)
    order: list[int] = []  # the gaps there are, ascending

    def leave(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    def place(length: int, first: int, n_bins: int, each: int, gap: int) -> None:
        runs.append((length, done[length], n_bins * each, first, each, capacity - gap))
        done[length] += n_bins * each
        left[length] -= n_bins * each

    large = sorted(x for x in counts if 3 * x > capacity)
    while large:
        length = large[-1]
        if not left[length]:
            large.pop()
            continue
        partner = None
        for other in reversed(large[: bisect_left(large, capacity - length + 1)]):
            if left[other] and (other != length or left[other] > 1):
                partner = other
                break
        n = left[length] if partner is None else left[length] // 2 if partner == length else min(left[length], left[partner])
        first, bins = bins, bins + n
        place(length, first, n, 1, capacity)
        if partner is None:
            leave(capacity - length, first, n)
        else:
            place(partner, first, n, 1, capacity - length)
            leave(capacity - length - partner, first, n)
        large = [x for x in large if left[x]]

    for length in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                n = max(1, left[length] // each)
                first, bins, gap = bins, bins + n, capacity
            else:
                gap = order[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            each = gap // length
            full = min(n, left[length] // each)
            if full:
                place(length, first, full, each, gap)
                leave(gap - each * length, first, full)
            rest, used = left[length], full
            if full < n and rest:  # fewer than a bin takes
                place(length, first + full, 1, rest, gap)
                leave(gap - rest * length, first + full, 1)
                used += 1
            leave(gap, first + used, n - used)
            if gap == capacity and used < n:
                raise AssertionError("a bin was opened for nothing")
    return runs


# --- ranks and places ------------------------------------------------------------------------------


def _ranked(pieces: DataFrame, total: int) -> DataFrame:
    """`pieces` with a gapless rank among those of their length; a length may hold all rows."""
    blocks = max(1, math.ceil(total / RANK_ROWS))
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int")
    pieces = pieces.withColumn("_block", block)
    ordered = Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "ids_crc32")
    pieces = pieces.withColumn("_within", F.row_number().over(ordered) - 1)
    if blocks == 1:
        return pieces.withColumn("_rank", F.col("_within").cast("long")).drop("_block", "_within")
    sizes = pieces.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "_block", before.alias("_before"))
    ranked = pieces.join(sizes, ["length", "_block"])
    return ranked.withColumn("_rank", F.col("_before") + F.col("_within")).drop("_block", "_within", "_before")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (doc_id, piece, length, ids_crc32, ...) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = sorted(plan_bins(counts, capacity))
    table = np.array(runs, np.int64).reshape(-1, 6)
    start = table[:, 0] * 2**48 + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "_rank"))
            own = table[np.searchsorted(start, length * 2**48 + rank, "right") - 1]
            nth = rank - own[:, 1]
            keep = [x for x in batch.schema.names if x != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(x)) for x in keep), pa.array(own[:, 3] + nth // own[:, 4]), pa.array(own[:, 5] + nth % own[:, 4] * length)],
                [*keep, "sequence_id", "offset"],
            )

    ranked = _ranked(pieces, sum(counts.values()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*pieces.columns, "_rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut_pieces(docs, vocabulary or default_vocabulary(), capacity)
    return pack(written(pieces, "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of placed pieces with their `ids`; a sequence has at most `capacity` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(parts, lambda x: F.hex(x["ids"])), F.lit(""), lambda a, x: F.concat(a, x))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(joined).alias("ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
