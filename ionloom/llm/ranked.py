"""Ranked lexical search: the best documents for each query, by integer scores, over geometrically blocked postings.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII, A to Z lower-cased. With N documents that
have a term, L terms in all, n terms in a document, a term in df documents and tf times in this one:

    weight = floor(1000 * ln((2 N + 2) / (2 df + 1)))        m = 50 + (50 n N) div L
    impact = 1000000000 tf div (1000 tf + 20 m)              score = sum of weight * impact over the query's terms

1. `vectors`: one pass over the texts gives a row per document with its term counts, for terms of the queries only.
2. `statistics`: N, L, and df and the highest impact of each term, added up in the tasks before the shuffle.
3. `probe`: the documents in the rarest lists of each query are scored; the score at the last rank asked for is a
   threshold that every document in the result reaches.
4. `index`: the documents are range-partitioned by the signs of random projections of their weighted vectors, so that alike
   ones lie together, and cut into chunks. Within a chunk each term's posting list is cut, in that order, into blocks
   of alike documents, and each block has a summary: the maximum of its documents' impacts in each coordinate, kept for
   the terms that occur in a query together with the block's term. Lists are left out that no query needs: a document that has
   only terms whose highest scores together stay below the threshold cannot reach it.
5. `search`: for each query the blocks of its lists are taken in order of their bounds (weights times summary); a block
   is skipped only if its bound is below the threshold, which rises with the documents scored. Others are scored whole from the chunk's vectors.

The queries, their terms and thresholds are sent to all tasks; queries are taken in blocks with at most TERMS_AT_ONCE distinct terms in
all, so their size is bounded whatever the number of queries. No pairs of query and document leave a task but the best of each
task: at most `top` per query and chunk of documents.

A document of null text, or without terms, is in no result. A row of `docs` is a document, also when its doc_id occurs
again; equal scores are ordered by doc_id, null last. Rows of one item_id (null is one too) are one query with the terms of
all; a query without terms has no rows. Empty tables give no rows. Columns other than those named are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionloom.llm.common import documents, written

#: Distinct terms of the queries of one block.
TERMS_AT_ONCE = 500_000
#: Documents of a chunk, documents of a block, signs by which documents are ordered, documents a probe scores at least per query.
CHUNK, BLOCK, SIGNS, PROBED = 4096, 64, 32, 500
TOP = 50

_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if text else []


def term_counts(text: str | None) -> tuple[Counter, int]:
    counts = Counter(terms_of(text))
    counts.pop(b"", None)
    return counts, sum(counts.values())


# --- queries ----------------------------------------------------------------------------------------


@dataclass
class Queries:
    """The queries of one block as numbers: `terms` of query q are numbers[starts[q]:starts[q + 1]], rarest first."""

    items: list[int | None]
    vocabulary: dict[bytes, int]
    starts: np.ndarray
    numbers: np.ndarray
    #: by term: weight, df, highest impact; by query: threshold and how many of its terms need a visit
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    df: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    highest: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    needed: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def terms(self, q: int) -> np.ndarray:
        return self.numbers[self.starts[q] : self.starts[q + 1]]

    def visited(self, q: int) -> np.ndarray:
        """The terms of `q` at least one of which every document of the result has."""
        return self.terms(q)[: self.needed[q]]

    def order(self) -> None:
        """Terms of each query by their highest score, best first."""
        for q in range(len(self.items)):
            own = self.terms(q)
            self.numbers[self.starts[q] : self.starts[q + 1]] = own[np.argsort(-(self.weight * self.highest)[own], kind="stable")]

    def set_thresholds(self, threshold: np.ndarray) -> None:
        """Thresholds, and with them the lists that must be visited: those after the first whose rest can reach the threshold."""
        self.threshold = np.maximum(threshold, 1)
        self.needed = np.zeros(len(self.items), np.int64)
        for q in range(len(self.items)):
            rest = np.cumsum((self.weight * self.highest)[self.terms(q)][::-1])[::-1]
            self.needed[q] = int((rest >= self.threshold[q]).sum())

    def by_term(self, terms_of_query) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        for q in range(len(self.items)):
            for t in terms_of_query(q).tolist():
                found.setdefault(t, []).append(q)
        return found


def query_blocks(items: DataFrame, text: str, item_id: str, limit: int = TERMS_AT_ONCE) -> Iterator[Queries]:
    """The queries of `items` in blocks of at most about `limit` distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms = [], []
            for item, value in zip(*(c.to_pylist() for c in batch.columns)):
                found = list(term_counts(value)[0])
                ids += [item] * len(found)
                terms += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], ["item", "term"])

    terms = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text")).mapInArrow(run, "item long, term binary").distinct()
    terms = written(terms, "query-terms")
    parts = max(1, math.ceil(terms.count() / limit))
    for part in range(parts):
        rows = terms.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).orderBy("item", "term").collect() if parts > 1 else terms.orderBy("item", "term").collect()
        if not rows:
            continue
        vocabulary: dict[bytes, int] = {}
        own: dict[int | None, list[int]] = {}
        for row in rows:
            own.setdefault(row["item"], []).append(vocabulary.setdefault(bytes(row["term"]), len(vocabulary)))
        starts = np.r_[0, np.cumsum([len(x) for x in own.values()])]
        yield Queries(list(own), vocabulary, starts, np.array([t for x in own.values() for t in x], np.int64))


# --- vectors and statistics -------------------------------------------------------------------------


def vectors(docs: DataFrame, queries: Queries) -> DataFrame:
    """doc_id, n, terms, counts of every document with a term; terms of no query count in n only."""
    known = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = known.value
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                ids, sizes, terms, counts, ends = [], [], [], [], [0]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    found, n = term_counts(text.as_py())
                    if not n:
                        continue
                    for term in found.keys() & numbers.keys():
                        terms.append(numbers[term])
                        counts.append(found[term])
                    ids.append(doc_id)
                    sizes.append(n)
                    ends.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


class Chunk:
    """Some documents as arrays: document d has terms[starts[d]:starts[d + 1]] with their impacts."""

    def __init__(self, batch: pa.RecordBatch, total: int, length: int):
        self.ids = batch.column("doc_id")
        sizes = batch.column("n").to_numpy()
        self.starts = _starts(batch.column("terms"))
        self.terms = batch.column("terms").flatten().to_numpy().astype(np.int64)
        counts = batch.column("counts").flatten().to_numpy().astype(np.int64)
        m = 50 + (50 * sizes * total) // max(length, 1)
        self.doc = np.repeat(np.arange(len(sizes)), np.diff(self.starts))
        self.impacts = (1_000_000_000 * counts) // (1000 * counts + 20 * m[self.doc])

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The scores of some documents, with the weight of each term, zero for terms not in the query."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[docs] - (ends - sizes), sizes)
        sums = np.r_[0, np.cumsum(weights[self.terms[at]] * self.impacts[at])]
        return sums[ends] - sums[ends - sizes]


def _starts(lists: pa.Array) -> np.ndarray:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0]


def statistics(rows: DataFrame, queries: Queries) -> tuple[int, int]:
    """N and L; fills in df, weight and highest impact of the queries' terms."""
    total, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = len(queries.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, highest = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            chunk = Chunk(batch, total, length)
            df += np.bincount(chunk.terms, minlength=size)
            np.maximum.at(highest, chunk.terms, chunk.impacts)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some]), pa.array(highest[some])], ["term", "df", "highest"])

    parts = rows.mapInArrow(run, "term long, df long, highest long")
    queries.df, queries.highest = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for term, df, highest in parts.groupBy("term").agg(F.sum("df"), F.max("highest")).collect():
        queries.df[term], queries.highest[term] = df, highest
    queries.weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in queries.df.tolist()], np.int64)
    queries.order()
    return total, length


# --- the best of each query -------------------------------------------------------------------------


class Best:
    """The best `top` (score, doc_id) of each query so far, in ranked order."""

    def __init__(self, queries: Queries, top: int):
        self.queries, self.top = queries, top
        self.floor = queries.threshold.copy() if len(queries.threshold) else np.ones(len(queries.items), np.int64)
        self.found: dict[int, list[tuple[int, bool, int]]] = {}

    def add(self, q: int, scores: np.ndarray, ids: pa.Array, docs: np.ndarray) -> None:
        good = scores >= self.floor[q]
        if not good.any():
            return
        own = ids.take(pa.array(docs[good])).to_pylist()
        rows = [(-s, i is None, i or 0) for s, i in zip(scores[good].tolist(), own)]
        kept = sorted(self.found.get(q, []) + rows)[: self.top]
        self.found[q] = kept
        if len(kept) == self.top:
            self.floor[q] = max(self.floor[q], -kept[-1][0])

    def batch(self) -> pa.RecordBatch:
        rows = [(q, None if none else i, -s) for q, kept in self.found.items() for s, none, i in kept]
        self.found = {}
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ([], [], []))], ["query", "doc_id", "score"])


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` of each query with their rank; `rows` has at most `top` a query and task."""
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def probe(rows: DataFrame, queries: Queries, total: int, length: int, top: int) -> np.ndarray:
    """For each query the score at rank `top` among documents in its rarest lists; 1 where there are fewer."""
    few = max(PROBED, 2 * top)

    def rarest(q: int) -> np.ndarray:
        own = queries.terms(q)
        own = own[np.argsort(queries.df[own], kind="stable")]
        return own[: int(np.searchsorted(np.cumsum(queries.df[own]), few)) + 1]

    lists = queries.by_term(rarest)
    state = rows.sparkSession.sparkContext.broadcast((queries, lists))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, visits = state.value
        wanted, weights = np.zeros(len(own.vocabulary), bool), np.zeros(len(own.vocabulary), np.int64)
        wanted[list(visits)] = True
        best = Best(own, top)
        for batch in batches:
            chunk = Chunk(batch, total, length)
            docs: dict[int, list[np.ndarray]] = {}
            for term, members in _postings(chunk, wanted):
                for q in visits[term]:
                    docs.setdefault(q, []).append(members)
            for q, members in docs.items():
                weights[own.terms(q)] = own.weight[own.terms(q)]
                some = np.unique(np.concatenate(members))
                best.add(q, chunk.scores(some, weights), chunk.ids, some)
                weights[own.terms(q)] = 0
        yield best.batch()

    last = _ranked(rows.mapInArrow(run, "query long, doc_id long, score long"), top).where(F.col("rank") == top)
    threshold = np.ones(len(queries.items), np.int64)
    for q, score in last.select("query", "score").collect():
        threshold[q] = score
    return threshold


def _postings(chunk: Chunk, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(term, documents in order) of the wanted terms of a chunk."""
    at = np.flatnonzero(wanted[chunk.terms])
    at = at[np.argsort(chunk.terms[at], kind="stable")]
    terms = chunk.terms[at]
    borders = np.flatnonzero(np.diff(terms)) + 1
    for part in np.split(at, borders) if len(at) else []:
        yield int(chunk.terms[part[0]]), chunk.doc[part]


# --- the index --------------------------------------------------------------------------------------


def by_likeness(rows: DataFrame, queries: Queries, total: int, length: int) -> DataFrame:
    """`rows` with alike documents next to each other: sorted by the signs of random projections of their vectors."""
    weight = rows.sparkSession.sparkContext.broadcast(queries.weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(13).standard_normal((len(weight.value), SIGNS)).astype(np.float32)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                chunk = Chunk(part, total, length)
                values = (weight.value[chunk.terms] * chunk.impacts).astype(np.float32)
                codes = np.zeros(part.num_rows, np.int64)
                for sign in range(SIGNS):
                    side = np.bincount(chunk.doc, values * planes[chunk.terms, sign], part.num_rows)
                    codes = codes * 2 + (side > 0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codes)], [*part.schema.names, "code"])

    coded = rows.mapInArrow(run, rows.schema.simpleString()[len("struct<") : -1] + ",code:bigint")
    spread = F.xxhash64("doc_id", "n")  # equal codes may fill several partitions
    return coded.withColumn("spread", spread).repartitionByRange("code", "spread").sortWithinPartitions("code", "spread").drop("code", "spread")


_LISTS = ["list_terms", "list_starts", "block_starts", "members", "summary_starts", "summary_terms", "summary_values"]


def build_blocks(chunk: Chunk, queries: Queries, needed: np.ndarray, together: dict[int, np.ndarray]) -> list[np.ndarray]:
    """The posting lists of the needed terms, cut into blocks of alike documents with their summaries, as flat arrays.

    Lists i has blocks list_starts[i] to list_starts[i + 1]; block b has documents members[block_starts[b]:block_starts[b + 1]]
    and coordinates summary_starts[b] to summary_starts[b + 1].
    """
    names, lists, blocks, members, summaries, coordinates, values = [], [0], [0], [], [0], [], []
    kept = np.zeros(len(queries.vocabulary), bool)
    highest = np.zeros(len(queries.vocabulary), np.int64)
    for term, docs in _postings(chunk, needed):
        kept[together[term]] = True
        for low in range(0, len(docs), BLOCK):
            some = docs[low : low + BLOCK]
            at = np.concatenate([np.arange(chunk.starts[d], chunk.starts[d + 1]) for d in some])
            at = at[kept[chunk.terms[at]]]
            np.maximum.at(highest, chunk.terms[at], chunk.impacts[at])
            own = np.unique(chunk.terms[at])
            coordinates.append(own)
            values.append(highest[own])
            highest[own] = 0
            members.append(some)
            blocks.append(blocks[-1] + len(some))
            summaries.append(summaries[-1] + len(own))
        kept[together[term]] = False
        names.append(term)
        lists.append(len(blocks) - 1)
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (members, coordinates, values)]
    return [np.array(names, np.int64), np.array(lists), np.array(blocks), flat[0], np.array(summaries), flat[1], flat[2]]


def index(rows: DataFrame, queries: Queries, total: int, length: int) -> DataFrame:
    """One row per chunk of alike documents: their vectors, and the blocks and summaries of the lists that queries need."""
    spark = rows.sparkSession
    state = spark.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = state.value
        visits = own.by_term(own.visited)
        together = {t: np.unique(np.concatenate([own.terms(q) for q in qs])) for t, qs in visits.items()}
        needed = np.zeros(len(own.vocabulary), bool)
        needed[list(visits)] = True
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK):
                part = batch.slice(low, CHUNK)
                arrays = build_blocks(Chunk(part, total, length), own, needed, together)
                ids, sizes = (pa.array([part.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("doc_id", "n"))
                vectors_ = [_starts(part.column("terms")), *(part.column(c).flatten().to_numpy() for c in ("terms", "counts"))]
                flat = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int32))) for x in (*vectors_, *arrays)]
                yield pa.RecordBatch.from_arrays([ids, sizes, *flat], ["doc_id", "n", "starts", "terms", "counts", *_LISTS])

    more = ", ".join(f"{c} array<int>" for c in ["starts", "terms", "counts", *_LISTS])
    return rows.select("doc_id", "n", "terms", "counts").mapInArrow(run, f"doc_id array<long>, n array<long>, {more}")


def search(chunks: DataFrame, queries: Queries, total: int, length: int, top: int) -> DataFrame:
    """query, doc_id, score, rank of the best documents, from the blocks of `index` that no bound excludes."""
    state = chunks.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = state.value
        visits = own.by_term(own.visited)
        weights = np.zeros(len(own.vocabulary), np.int64)
        best = Best(own, top)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].values for name in batch.schema.names}
                parts = [pa.ListArray.from_arrays(row["starts"].cast(pa.int32()), row[c]) for c in ("terms", "counts")]
                chunk = Chunk(pa.RecordBatch.from_arrays([row["doc_id"], row["n"], *parts], ["doc_id", "n", "terms", "counts"]), total, length)
                lists = {c: row[c].to_numpy().astype(np.int64) for c in _LISTS}
                place = {t: k for k, t in enumerate(lists["list_terms"].tolist())}
                for q in {q for t in place for q in visits[t]}:
                    weights[own.terms(q)] = own.weight[own.terms(q)]
                    found = [place[t] for t in own.visited(q).tolist() if t in place]
                    blocks = np.concatenate([np.arange(lists["list_starts"][k], lists["list_starts"][k + 1]) for k in found])
                    _visit(chunk, lists, blocks, q, weights, best)
                    weights[own.terms(q)] = 0
        yield best.batch()

    return _ranked(chunks.mapInArrow(run, "query long, doc_id long, score long"), top)


def _visit(chunk: Chunk, lists: dict[str, np.ndarray], blocks: np.ndarray, q: int, weights: np.ndarray, best: Best) -> None:
    """Scores the documents of those blocks whose bound reaches the threshold, best bounds first."""
    low, high = lists["summary_starts"][blocks], lists["summary_starts"][blocks + 1]
    ends = np.cumsum(high - low)
    at = np.arange(ends[-1]) + np.repeat(low - (ends - (high - low)), high - low)
    sums = np.r_[0, np.cumsum(weights[lists["summary_terms"][at]] * lists["summary_values"][at])]
    bounds = sums[ends] - sums[ends - (high - low)]
    order = np.argsort(-bounds, kind="stable")
    blocks, bounds = blocks[order], bounds[order]
    seen = np.zeros(len(chunk.ids), bool)
    for first in range(0, len(blocks), 8):  # a few at a time, so that the threshold can rise between
        some = blocks[first : first + 8][bounds[first : first + 8] >= best.floor[q]]
        if not len(some):
            return
        docs = np.unique(np.concatenate([lists["members"][lists["block_starts"][b] : lists["block_starts"][b + 1]] for b in some]))
        docs = docs[~seen[docs]]
        seen[docs] = True
        best.add(q, chunk.scores(docs, weights), chunk.ids, docs)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of `docs` for each item of `items`."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for queries in query_blocks(items, text, item_id):
        rows = written(vectors(docs, queries), "vectors")
        total, length = statistics(rows, queries)
        queries.set_thresholds(probe(rows, queries, total, length, top))
        chunks = written(index(by_likeness(rows, queries, total, length), queries, total, length), "blocks")
        found = search(chunks, queries, total, length, top)
        names = spark.createDataFrame(list(enumerate(queries.items)), "query long, item_id long")
        out = out.unionByName(found.join(names, "query").select("item_id", "rank", "doc_id", "score"))
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13_SQL = f"""
WITH numbered AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents
), words AS (SELECT row_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM numbered WHERE text IS NOT NULL
), counts AS (SELECT row_id, term, count(*) AS tf FROM words GROUP BY row_id, term
), sizes AS (SELECT row_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY row_id
), corpus AS (SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS length FROM sizes
), frequencies AS (SELECT term, count(*) AS df FROM counts GROUP BY term
), wanted AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark WHERE text IS NOT NULL)
), weighted AS (
  SELECT w.item_id, w.term, CAST(floor(1000 * ln(CAST(2 * total + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM wanted w JOIN frequencies USING (term), corpus
), scored AS (
  SELECT w.item_id, c.row_id, CAST(sum(w.weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total) // length)))) AS BIGINT) AS score
  FROM weighted w JOIN counts c USING (term) JOIN sizes USING (row_id), corpus GROUP BY w.item_id, c.row_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scored JOIN numbered USING (row_id) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
