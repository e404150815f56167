"""SentencePiece encoding and decoding over a relational lattice.

A text becomes blanks-as-marks with one mark in front, and is cut wherever no piece of the vocabulary spans two
neighbouring characters, so the ids of a text are those of its units one after the other. The lattice of a unit
is relational: its substrings of bounded length are exploded, joined with the piece table on the string, and
the matches (edges) grouped by unit. A fold with Spark's `aggregate` then picks the path:

* `viterbi` for unigram models: the best sum of scores, position by position.
* `merge` for BPE models: the neighbouring symbols whose union is the edge of the best score, leftmost of equal
  ones, become one, until no edge is left. The best sum of scores does not give a BPE model's ids: its scores
  are ranks of merges. So the fold differs, the lattice is the same.

Characters without a piece become the pieces of their bytes.

The most frequent units, DICTIONARY at most and of LATTICE_CHARS at most, are encoded this way and sent to all tasks, a
table of bounded size. Rarer units are encoded where they occur by the same rule, many side by side; joining every occurrence of a word back to its
text would shuffle one row per word of the corpus, several times the text. In the tasks the units of many texts are
dictionary-encoded, looked up once each, and put together by position; decoding gathers the bytes of the pieces.

A null text counts as empty and has no ids. Repeated rows are encoded alike. An empty table gives no rows;
columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm.common import claim_caches, documents, text_or_empty, text_slices, written

#: Units that the lattice encodes for all texts.
DICTIONARY = 100_000
#: Units longer than this are left to the tasks; no lattice is made of them.
LATTICE_CHARS = 48
#: Rarer units that a worker remembers, and bytes of text that are split together.
RECENT, SLICE = 100_000, 3 << 20
#: Rank of two neighbours that make no piece.
_NONE = 2**31 - 1
ENCODED = "doc_id long, ids array<int>"
MARK = "▁"


class Vocabulary:
    """Pieces with ids and scores, the ids of bytes, and the pairs of characters that pieces span."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], unknown: int = 0):
        self.pieces, self.byte_ids, self.unknown = pieces, byte_ids, unknown
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.longest = max(map(len, pieces), default=1)
        self.names = {number: piece for piece, (number, _) in pieces.items()}
        self.bytes = {number: value for value, number in enumerate(byte_ids)}

    @classmethod
    @cache
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(model.is_byte(i) for i in range(size)) else []
        return cls({model.id_to_piece(i): (i, model.get_score(i)) for i in plain}, byte_ids, model.unk_id())

    @cached_property
    def borders(self) -> np.ndarray:
        """Whether a text is cut between two neighbouring bytes, by 256 * first + second, blanks for marks.

        Characters beyond ASCII count as one here: a cut next to them needs that no piece spans any of them and the other one.
        """
        spanned = np.zeros((256, 256), bool)
        spanned[128:, 128:] = True
        for pair in self.pairs:
            left, right = (ord(c) if c.isascii() else slice(128, 256) for c in pair.replace(MARK, " "))
            spanned[left, right] = True
        return ~spanned.ravel()

    @cached_property
    def letters(self) -> np.ndarray:
        """The piece that each code point is, -1 for none."""
        found = np.full(0x110000, -1, np.int32)
        for piece, (number, _) in self.pieces.items():
            if len(piece) == 1:
                found[ord(piece)] = number
        return found

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def merge(self, unit: str) -> list[int]:
        """The ids of a unit by merging with a queue: the best pair first, the leftmost of equal ones."""
        symbols: list[str | None] = list(unit)
        after, before = list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < len(symbols):
                joined = symbols[left] + symbols[right]
                if joined in self.pieces:
                    heapq.heappush(queue, (-self.pieces[joined][1], left, joined))

        for i in range(len(unit) - 1):
            offer(i)
        while queue:
            _, left, joined = heapq.heappop(queue)
            if symbols[left] is None or after[left] >= len(symbols) or symbols[left] + symbols[after[left]] != joined:
                continue
            right = after[left]
            symbols[left], symbols[right], after[left] = joined, None, after[right]
            if after[left] < len(symbols):
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        ids: list[int] = []
        for s in symbols:
            if s is not None:
                ids += [self.pieces[s][0]] if s in self.pieces else self.fallback(s)
        return ids

    @cached_property
    def joins(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, joined, ranks), by pair: two pieces as left * 2**32 + right, the piece they make, and the rank of its score, 0 for the best."""
        found = {}
        for piece, (number, score) in self.pieces.items():
            for at in range(1, len(piece)):
                if piece[:at] in self.pieces and piece[at:] in self.pieces:
                    found[self.pieces[piece[:at]][0] << 32 | self.pieces[piece[at:]][0]] = number, -score
        pairs = np.array(sorted(found), np.int64)
        ranks = np.unique([found[p][1] for p in pairs.tolist()], return_inverse=True)[1]
        return pairs, np.array([found[p][0] for p in pairs.tolist()], np.int32), ranks.astype(np.int32)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair, _NONE for no piece, and the piece it makes."""
        pairs, joined, ranks = self.joins
        keys = left.astype(np.int64) << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
        good = (pairs[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(good, ranks[at], _NONE), joined[at]

    def merge_many(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of each unit, blanks for marks, one after the other, and how many each has.

        Units of like length are merged side by side, each its best pair a round; long ones and those with characters
        without a piece are merged one by one.
        """
        sizes = pc.utf8_length(units).to_numpy().astype(np.int64)
        points = np.frombuffer("".join(units.to_pylist()).replace(" ", MARK).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters, first = self.letters[points], np.cumsum(sizes) - sizes
        strange = np.add.reduceat(letters < 0, first) > 0 if len(sizes) else np.empty(0, bool)
        single = strange | (sizes > 24) | (len(self.joins[0]) == 0)
        counts, at, made = np.zeros(len(sizes), np.int64), [], []
        alone = np.flatnonzero(single)
        for i, unit in zip(alone.tolist(), units.take(pa.array(alone)).to_pylist()):
            ids = self.merge(unit.replace(" ", MARK))
            counts[i] = len(ids)
            at.append(np.full(len(ids), i))
            made.append(np.array(ids, np.int32))
        plain = np.flatnonzero(~single)
        plain = plain[np.argsort(sizes[plain], kind="stable")]
        for low in range(0, len(plain), 4096):
            own = plain[low : low + 4096]
            symbols = self._merged(gathered(letters, first[own], sizes[own]), sizes[own])
            kept = symbols >= 0
            counts[own] = kept.sum(1)
            at.append(np.repeat(own, counts[own]))
            made.append(symbols[kept])
        order = np.argsort(np.concatenate([*at, np.empty(0, np.int64)]), kind="stable")
        return np.concatenate([*made, np.empty(0, np.int32)])[order], counts

    def _merged(self, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A row of symbols for each unit, -1 after the last, of the pieces of its characters."""
        width = int(sizes.max()) + 1  # the last column stays empty
        columns = np.arange(width)
        symbols = np.full((len(sizes), width), -1, np.int32)
        symbols[columns < sizes[:, None]] = letters
        done = symbols.copy()
        ranks, pieces = self._joined(symbols[:, :-1], symbols[:, 1:])
        rows = np.arange(len(sizes))
        while len(rows):
            best = ranks.argmin(1)
            some = ranks[np.arange(len(rows)), best] < _NONE
            done[rows[~some], :width] = symbols[~some]
            rows, best, symbols, ranks, pieces = rows[some], best[some], symbols[some], ranks[some], pieces[some]
            if not len(rows):
                break
            # One symbol and one pair fewer: what is right of the best pair moves up.
            own = np.arange(len(rows))
            made = pieces[own, best]
            later = columns[: width - 1] > best[:, None]
            symbols[:, :-1] = np.where(later, symbols[:, 1:], symbols[:, :-1])
            symbols[own, best] = made
            later = columns[: width - 2] >= best[:, None]
            ranks[:, :-1] = np.where(later, ranks[:, 1:], ranks[:, :-1])
            pieces[:, :-1] = np.where(later, pieces[:, 1:], pieces[:, :-1])
            ranks[:, -1] = _NONE
            for at in (best - 1, best):
                there = np.flatnonzero((at >= 0) & (at < width - 1))
                where = at[there]
                ranks[there, where], pieces[there, where] = self._joined(symbols[there, where], symbols[there, where + 1])
        return done

    def decode(self, ids: list[int]) -> str:
        out = bytearray()
        for number in ids:
            if number in self.bytes:
                out.append(self.bytes[number])
            else:
                out += self.names.get(number, "").encode("utf-8", "surrogatepass")
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text.removeprefix(" ")

    def piece_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, first, size): what each id stands for in UTF-8, marks as blanks; ids of no piece stand for nothing."""
        size = max([*self.names, *self.bytes], default=0) + 1
        parts = [b""] * size
        for number, piece in self.names.items():
            parts[number] = piece.replace(MARK, " ").encode("utf-8", "surrogatepass")
        for number, value in self.bytes.items():
            parts[number] = bytes([value])
        sizes = np.fromiter(map(len, parts), np.int64, size)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score); its size is that of the vocabulary."""
        return spark.createDataFrame([(p, i, float(s)) for p, (i, s) in self.pieces.items()], "piece string, id int, score double")


def split_units(texts: pa.Array, borders: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """(units, offsets): the units of all texts with blanks for marks, and where each text's begin and end."""
    marked = pc.binary_join_element_wise(pc.if_else(pc.equal(texts, ""), "", " "), pc.replace_substring(texts, MARK, " "), "")
    ends = np.frombuffer(marked.buffers()[1], np.int32, len(marked) + 1, 4 * marked.offset)
    if not ends[-1]:
        return pa.array([], pa.string()), np.zeros(len(ends), np.int64)
    data = np.frombuffer(marked.buffers()[2], np.uint8, ends[-1])
    begins = np.r_[True, borders[data[:-1].astype(np.uint16) << 8 | data[1:]], True]
    begins[ends] = True
    first = np.flatnonzero(begins).astype(np.int32)
    return pa.StringArray.from_buffers(len(first) - 1, pa.py_buffer(first), marked.buffers()[2]), np.searchsorted(first, ends)


def gathered(pool: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The parts of `pool` that begin at `first` and have `count` entries, one after the other."""
    ends = np.cumsum(count)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)]


class UnitIds:
    """Ids of texts unit by unit: from a given dictionary, from units remembered from the texts before, or by merging."""

    def __init__(self, vocabulary: Vocabulary, dictionary: dict[str, bytes]):
        self.vocabulary = vocabulary
        names = pa.array([unit.replace(MARK, " ") for unit in dictionary], pa.string())
        sizes = np.fromiter((len(ids) // 4 for ids in dictionary.values()), np.int64, len(dictionary))
        self.dictionary = names, sizes, np.frombuffer(b"".join(dictionary.values()), np.int32)
        self.clear()

    def clear(self) -> None:
        self.recent = pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int32)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts, and where each text's begin and end."""
        units, offsets = split_units(texts, self.vocabulary.borders)
        encoded = units.dictionary_encode()
        place, tables = np.full(len(encoded.dictionary), -1, np.int64), [self.dictionary, self.recent]
        base = 0
        for names, _, _ in tables:
            open_ = np.flatnonzero(place < 0)
            found = pc.fill_null(pc.index_in(encoded.dictionary.take(pa.array(open_)), value_set=names), -1).to_numpy()
            place[open_] = np.where(found < 0, -1, found + base)
            base += len(names)
        fresh = np.flatnonzero(place < 0)
        rare = encoded.dictionary.take(pa.array(fresh))
        ids, counts = self.vocabulary.merge_many(rare)
        tables.append((rare, counts, ids))
        place[fresh] = base + np.arange(len(fresh))
        sizes = np.concatenate([counts for _, counts, _ in tables])
        pool = np.concatenate([ids for _, _, ids in tables])
        first = np.cumsum(sizes) - sizes
        if len(self.recent[0]) + len(rare) > RECENT:
            self.recent = tables[2]
        else:
            self.recent = pa.concat_arrays([self.recent[0], rare]), np.r_[self.recent[1], counts], np.r_[self.recent[2], ids]
        at = place[encoded.indices.to_numpy()]
        own = sizes[at]
        return gathered(pool, first[at], own), np.r_[0, np.cumsum(own)][offsets]


# --- the lattice ------------------------------------------------------------------------------------


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(unit, n, edges): for each distinct unit its length and the pieces in it as (s, e, id, score)."""
    n = F.char_length("unit")
    starts = units.select("unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = starts.select("unit", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("s")))).alias("k"))
    found = spans.withColumn("piece", F.substring("unit", F.col("s") + 1, F.col("k"))).join(F.broadcast(pieces), "piece")
    edge = F.struct("s", (F.col("s") + F.col("k")).alias("e"), "id", "score")
    edges = found.groupBy("unit").agg(F.collect_list(edge).alias("edges"))
    return units.join(edges, "unit", "left").select("unit", n.alias("n"), F.coalesce("edges", F.array().cast("array<struct<s:int,e:int,id:int,score:double>>")).alias("edges"))


def merge_path(n: Column, edges: Column) -> Column:
    """The borders between symbols after all merges, by a fold over at most n - 1 of them."""

    def step(borders: Column, _: Column) -> Column:
        near = F.filter(edges, lambda x: (F.array_position(borders, x["e"]) - F.array_position(borders, x["s"]) == 2) & (F.array_position(borders, x["s"]) > 0))
        best = F.array_max(F.transform(near, lambda x: F.struct(x["score"].alias("score"), (-x["s"]).alias("minus_s"), x["e"].alias("e"))))
        merged = F.transform(F.array(best), lambda b: F.when(b.isNull(), borders).otherwise(F.filter(borders, lambda x: (x <= -b["minus_s"]) | (x >= b["e"]))))
        return merged[0]

    return F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), step)


def viterbi_path(n: Column, edges: Column) -> Column:
    """The borders of the path with the best sum of scores; a character without an edge costs ten more than the worst score."""
    worst = F.coalesce(F.array_min(F.transform(edges, lambda x: x["score"])), F.lit(0.0)) - 10
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s")))

    def step(state: Column, e: Column) -> Column:
        ending = F.transform(F.filter(edges, lambda x: x["e"] == e), lambda x: F.struct((F.get(state, x["s"])["score"] + x["score"]).alias("score"), x["s"].alias("s")))
        single = F.array(F.struct((F.get(state, e - 1)["score"] + worst).alias("score"), (e - 1).alias("s")))
        return F.concat(state, F.array(F.array_max(F.concat(ending, single))))

    best = F.aggregate(F.sequence(F.lit(1), n), start, step)

    def back(path: Column, _: Column) -> Column:
        return F.when(F.get(path, F.lit(0)) == 0, path).otherwise(F.concat(F.array(F.get(best, F.get(path, F.lit(0)))["s"]), path))

    return F.aggregate(F.sequence(F.lit(1), n), F.array(n), back)


def encode_units(units: DataFrame, vocabulary: Vocabulary, fold: str = "merge") -> DataFrame:
    """(unit, ids) of distinct units; in ids a character without a piece is its code point, below zero."""
    rows = lattice(units, vocabulary.table(units.sparkSession), vocabulary.longest)
    path = {"merge": merge_path, "viterbi": viterbi_path}[fold](F.col("n"), F.col("edges"))
    rows = rows.withColumn("path", path)
    pairs = F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("s"), F.get("path", i + 1).alias("e")))
    missing = F.lit(-1)
    ids = F.transform(pairs, lambda p: F.coalesce(F.get(F.transform(F.filter("edges", lambda x: (x["s"] == p["s"]) & (x["e"] == p["e"])), lambda x: x["id"]), F.lit(0)), missing))
    return rows.select("unit", pairs.alias("spans"), ids.alias("ids"))


# --- documents --------------------------------------------------------------------------------------


def unit_counts(docs: DataFrame, path: str) -> DataFrame:
    """(unit, n) over all texts, to choose the dictionary by: every task adds up its own before the shuffle.

    What a task has met once between two flushes is not passed on, so counts are lower bounds. Which units the dictionary holds
    changes no result: all others are encoded by the same rule where they occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = Vocabulary.load(path).borders
        seen, held = [], 0

        def flush() -> pa.RecordBatch:
            total = pa.concat_tables(seen).group_by("unit").aggregate([("n", "sum")]).select(["unit", "n_sum"]).rename_columns(["unit", "n"])
            seen.clear()
            kept = total.filter(pc.and_(pc.greater(total["n"], 1), pc.less_equal(pc.utf8_length(total["unit"]), LATTICE_CHARS)))
            units = pc.replace_substring(kept["unit"], " ", MARK)
            return pa.RecordBatch.from_arrays([units.combine_chunks(), kept["n"].combine_chunks()], ["unit", "n"])

        for batch in batches:
            for part in text_slices(batch, 0, SLICE):
                met = split_units(part.column(0), borders)[0].value_counts()
                seen.append(pa.table({"unit": met.field("values"), "n": met.field("counts")}))
                held += len(met)
                if held > 150_000:
                    yield flush()
                    held = 0
        if seen:
            yield flush()

    parts = docs.select(text_or_empty().alias("text")).mapInArrow(run, "unit string, n long")
    return parts.groupBy("unit").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The units more frequent than a limit that leaves no more than `size` of them; no task sorts them."""
    step = F.floor(F.log2("n") * 16).cast("int").alias("step")
    left, least = size, None
    for step_, n in sorted(counts.groupBy(step).count().collect(), reverse=True):
        if n > left:
            break
        left, least = left - n, step_
    return counts.where(F.floor(F.log2("n") * 16).cast("int") >= least).select("unit") if least is not None else counts.limit(0).select("unit")


def dictionary(docs: DataFrame, path: str, size: int = DICTIONARY) -> dict[str, bytes]:
    """The ids of the most frequent units, from the lattice."""
    vocabulary = Vocabulary.load(path)
    top = most_frequent(written(unit_counts(docs, path), "unit-counts"), size)
    known = {}
    for row in encode_units(written(top.repartition("unit"), "units"), vocabulary).collect():
        ids: list[int] = []
        for span, number in zip(row["spans"], row["ids"]):
            ids += [number] if number >= 0 else vocabulary.fallback(row["unit"][span["s"] : span["e"]])
        known[row["unit"]] = np.array(ids, np.int32).tobytes()
    return known


def encode(docs: DataFrame, path: str | None = None, size: int = DICTIONARY, then: Callable | None = None, schema: str = ENCODED) -> DataFrame:
    """(doc_id, ids) of whole texts; or what `then` makes of batches of these rows, of that schema, in the same worker.

    A second Python step of its own would be a second worker per core, with a vocabulary each.
    """
    path = path or default_model()
    known = docs.sparkSession.sparkContext.broadcast(dictionary(docs, path, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitIds(Vocabulary.load(path), known.value)
        claim_caches("pieces", encoder.clear)
        for batch in batches:
            for part in text_slices(batch, 1, SLICE):
                ids, offsets = encoder.of(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.mapInArrow((lambda batches: then(run(batches))) if then else run, schema)


class Decoder:
    """Texts of ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pool, self.first, self.sizes = vocabulary.piece_bytes()

    def of(self, lists: pa.ListArray) -> Iterator[bytes]:
        """The UTF-8 of each text; bytes that are none become replacement characters."""
        ids = lists.flatten().to_numpy()
        ids = np.where((ids >= 0) & (ids < len(self.sizes)), ids, 0)
        raw = gathered(self.pool, self.first[ids], self.sizes[ids]).tobytes()
        ends = np.r_[0, np.cumsum(self.sizes[ids])][lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        for low, high in zip(ends, ends[1:]):
            own = raw[low:high]
            yield own.decode("utf-8", "replace").encode("utf-8").removeprefix(b" ")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Vocabulary.load(path))
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.decode() for x in decoder.of(part.column(1))], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the number of ids, the ids, and the SHA-256 of the text decoded from them."""
    path = default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Vocabulary.load(path))
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                ids = part.column(1)
                digests = [hashlib.sha256(x).hexdigest() for x in decoder.of(ids)]
                yield pa.RecordBatch.from_arrays([part.column(0), pc.cast(pc.list_value_length(ids), pa.int64()), ids, pa.array(digests, pa.string())], ["doc_id", "n_ids", "ids", "decoded_sha256"])

    return encode(documents(spark, sf_dir), path, then=run, schema="doc_id long, n_ids long, ids array<int>, decoded_sha256 string")
