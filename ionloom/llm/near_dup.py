"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

Documents are linked when the Jaccard similarity of their sets of word shingles is at least `similarity`;
links are confirmed on the full sets. A component is what links reach, and its smallest doc_id stays.

Documents with equal sets are one class from the start. A class has COORDINATES coordinates, each the values of JOINED
min-hashes together, that are posted, each as a coordinate-value pair, and as many of those as MATCHES must agree in a pair of
similar classes: at a similarity of exactly 0.8 fewer agree with a probability of about 1e-9. So, with the pairs of a class ordered
by how many classes share them, its MATCHES - 1 most frequent pairs can be skipped: two classes that agree in
MATCHES pairs agree in one of the others. Of unlike texts hardly any share a value of several min-hashes, so what is left
are short lists, but for the lists of real near copies.

Every list first tests its members against one of them, its hub: the member whose pairs are shared most, which
is the text that others are copies of. What these tests link is one component, and members of one component need no test
with each other. Only around hubs whose members are in several components the test goes on: every member outside the
largest of these components meets all members of others. A hub's members are dealt over blocks of BLOCK, and a member
outside the largest component visits each block, so a group of near copies costs about as many rows as it has members. A
candidate must agree in enough coordinates of the whole signature before its texts are compared; members with such a
candidate are compared once more with their texts, and only links leave a task.

Null and empty texts have no shingles and are linked with nothing. Rows with a null doc_id take part; they
never name a component that has another doc_id. An empty table gives no rows; columns other than doc_id and
text are not looked at. Whole texts are read, however long.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionloom.llm.common import documents, heavy_keys, salted_join, sealed, text_or_empty, unsealed, written
from ionloom.llm.shingles import claim_hashes, min_hashes, permutations, shingle_set
from ionloom.operators.components import connected_components

#: Min-hashes of a signature, 16 bits of each; the first COORDINATES * JOINED of them make the posted coordinates.
SIGNATURE = 128
COORDINATES, JOINED = 42, 3
#: Posted coordinates that must agree: at a similarity of 0.8 one does with a probability of 0.8 ** 3, fewer with one of about 1e-9.
MATCHES = 4
#: Min-hashes of the whole signature that must agree: at a similarity of 0.8 fewer do with a probability below 1e-8.
AGREEING = 74
#: Members of a hub that a task holds to compare others with them: by signatures, and by texts.
BLOCK, TEXT_BLOCK = 4096, 512


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, row_key, n_shingles, set_key, sig): set_key is a 128-bit hash of the set; null, as sig, without shingles."""
    factors, offsets = permutations(SIGNATURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_hashes()
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for text in batch.column(2):
                shingles = shingle_set(text.as_py(), words)
                sizes.append(len(shingles))
                if len(shingles):
                    sig = min_hashes(shingles, factors, offsets)
                    keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    sigs.append(sig.astype("<u2").tobytes())
                else:
                    keys.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                ["doc_id", "row_key", "n_shingles", "set_key", "sig"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()).alias("row_key"), "text")
    return rows.mapInArrow(run, "doc_id long, row_key long, n_shingles long, set_key binary, sig binary")


def _tokens(classes: DataFrame) -> DataFrame:
    """(token, cid, size): the coordinate-value pairs of each class as 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = (np.arange(COORDINATES, dtype=np.int64) + 1) << 48
        for batch in batches:
            if batch.num_rows:
                sigs = batch.column(1).to_pylist()
                values = np.frombuffer(b"".join(sigs), "<u2").reshape(-1, SIGNATURE)[:, : COORDINATES * JOINED].astype(np.int64)
                values = values.reshape(-1, COORDINATES, JOINED) << np.array([32, 16, 0])
                tokens = (values.sum(2) + place).ravel()
                own = [pa.array(np.repeat(batch.column(i).to_numpy(), COORDINATES)) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(tokens), *own], ["token", "cid", "size"])

    return classes.select("cid", "sig", "n_shingles").mapInArrow(run, "token long, cid long, size long")


def postings(classes: DataFrame) -> DataFrame:
    """(token, cid, size, score) of the pairs that are not skipped; the score of a class is how often others share its pairs."""
    tokens = _tokens(classes)
    shared = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-tokens")
    heavy = heavy_keys(shared, "token", COORDINATES * classes.count())
    common = salted_join(tokens, shared, "token", "inner", heavy, F.xxhash64("cid"))
    own = F.sort_array(F.collect_list(F.struct("n", "token")), asc=False)  # COORDINATES at most
    kept = common.groupBy("cid").agg(F.slice(own, MATCHES, COORDINATES).alias("own"), F.sum("n").alias("score"), F.max("size").alias("size")).where(F.size("own") > 0)
    return kept.select("cid", "size", "score", F.explode("own.token").alias("token"))


class Signatures:
    """Signatures and set sizes of some classes, to find those that may be similar to one."""

    def __init__(self, sigs: list[bytes], sizes: list[int], similarity: float):
        self.values = np.frombuffer(b"".join(sigs), "<u2").reshape(len(sigs), SIGNATURE)
        self.sizes, self.similarity = np.array(sizes, np.int64), similarity

    def like(self, values: np.ndarray, size: int, among: np.ndarray) -> np.ndarray:
        """Those of `among` whose sizes and signatures allow the similarity with the given ones."""
        sizes = self.sizes[among]
        among = among[np.minimum(sizes, size) >= self.similarity * np.maximum(sizes, size) - 1e-9]
        return among[_agree(self.values[among] == values)]


def _agree(equal: np.ndarray) -> np.ndarray:
    """Whether enough min-hashes and enough posted coordinates agree; a row of `equal` per pair."""
    posted = equal[:, : COORDINATES * JOINED].reshape(-1, COORDINATES, JOINED).all(2).sum(1)
    return (equal.sum(1) >= AGREEING) & (posted >= MATCHES)


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The (a, b) of `pairs` that reach the similarity on their full sets."""
    percent = round(similarity * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_hashes()
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def shingles(cid: int, text: str) -> np.ndarray:
            if cid not in recent:
                recent[cid] = shingle_set(text, words)
                if len(recent) > 64:
                    recent.popitem(last=False)
            return recent[cid]

        for batch in batches:
            keep = []
            for a, b, text_a, text_b in zip(*(batch.column(i) for i in range(4))):
                x, y = shingles(a.as_py(), text_a.as_py()), shingles(b.as_py(), text_b.as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = {x: texts.select(F.col("cid").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab"}
    sizes = written(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "pairs-of-hubs")
    both = salted_join(pairs, side["b"], "b", "inner", heavy_keys(sizes, "b", pairs.count()), F.xxhash64("a")).join(side["a"].hint("shuffle_hash"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def candidates(classes: DataFrame, lists: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(hub, cid): the members of each hub; (a, b): members whose size and signature allow the similarity with their hub b.

    The hub of a list is its member with the highest score: of a text and its near copies, the text.
    """
    total = lists.count()
    top = F.max(F.struct("score", F.xxhash64("cid").alias("h"), "cid")).alias("hub")
    hubs = written(lists.groupBy("token").agg(top, F.count(F.lit(1)).alias("n")).where("n > 1").select("token", "n", F.col("hub.cid").alias("hub")), "hubs")
    stars = salted_join(lists, hubs.select("token", "hub"), "token", "inner", heavy_keys(hubs, "token", total), F.xxhash64("cid"))
    stars = written(stars.select("hub", "cid", "size").distinct(), "stars")
    sizes = written(stars.groupBy("hub").agg(F.count(F.lit(1)).alias("n")), "star-sizes")
    side = classes.select(F.col("cid").alias("hub"), F.col("n_shingles").alias("hub_n"), F.col("sig").alias("hub_sig"))
    both = salted_join(stars.where("hub <> cid"), side, "hub", "inner", heavy_keys(sizes, "hub", total), F.xxhash64("cid"))
    # The sizes of two sets bound their similarity: most rows end here, before signatures are sent.
    both = both.where(F.least("size", "hub_n") >= F.lit(similarity) * F.greatest("size", "hub_n") - 1e-9)
    both = both.join(classes.select("cid", "n_shingles", "sig").hint("shuffle_hash"), "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, hub = (Signatures(batch.column(f"{x}sig").to_pylist(), batch.column(f"{x}n" if x else "n_shingles").to_pylist(), similarity) for x in ("", "hub_"))
                good = _agree(own.values == hub.values)
                good &= np.minimum(own.sizes, hub.sizes) >= similarity * np.maximum(own.sizes, hub.sizes) - 1e-9
                yield batch.select(["cid", "hub"]).rename_columns(["a", "b"]).filter(pa.array(good))

    tested = both.select("cid", "hub", "n_shingles", "sig", "hub_n", "hub_sig").mapInArrow(run, "a long, b long")
    return stars, written(tested, "candidates")


def _unsettled(stars: DataFrame, parts: DataFrame) -> DataFrame:
    """(hub, n, cid, comp, minor): members around hubs that lie in several components.

    Hubs of one component count as one, so a group of near copies, whose lists have many hubs, is one set of members here.
    `minor`: outside the largest component of the hub's members.
    """
    names = parts.select(F.col("node").alias("cid"), "component").hint("shuffle_hash")
    around = stars.join(names.withColumnRenamed("cid", "hub").withColumnRenamed("component", "hub_comp").hint("shuffle_hash"), "hub", "left")
    members = around.select(F.coalesce("hub_comp", "hub").alias("hub"), "cid").distinct().join(names, "cid", "left")
    members = written(members.select("hub", "cid", F.coalesce("component", "cid").alias("comp")), "members")
    counts = members.groupBy("hub", "comp").agg(F.count(F.lit(1)).alias("n"))
    by_hub = counts.groupBy("hub").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp")).alias("most"))
    # Two members, of which one is the hub, have been tested with each other.
    mixed = written(by_hub.where("comps > 1 and n > 2").select("hub", "n", F.col("most.comp").alias("largest")), "mixed")
    around = salted_join(members, mixed, "hub", "inner", heavy_keys(mixed, "hub", members.count()), F.xxhash64("cid"))
    return around.select("hub", "n", "cid", "comp", (F.col("comp") != F.col("largest")).alias("minor"))


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """(hub, block, visits, cid, comp): every member in its block, and the minor ones as visitors in each block of their hub."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    home = F.struct(F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("block"), F.lit(False).alias("visits"))
    visits = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(i.alias("block"), F.lit(True).alias("visits")))
    places = F.explode(F.when(F.col("minor"), F.concat(F.array(home), visits)).otherwise(F.array(home))).alias("p")
    return members.select("hub", "cid", "comp", places).select("hub", "p.block", "p.visits", "cid", "comp")


def _partnered(members: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(hub, cid): the members that have a candidate in another component, found block by block; no more rows than were dealt."""

    def settle(hub: int, home: list[tuple], visitors: Iterator[tuple]) -> Iterator[tuple]:
        cids, comps, sizes, sigs = zip(*home)
        own, comps, seen = Signatures(sigs, sizes, similarity), np.array(comps), np.zeros(len(cids), bool)
        for cid, comp, size, sig in visitors:
            one = Signatures([sig], [size], similarity)
            near = own.like(one.values[0], size, np.flatnonzero(comps != comp))
            if len(near):
                seen[near] = True
                yield hub, cid
        for at in np.flatnonzero(seen).tolist():
            yield hub, cids[at]

    dealt = _dealt(members, BLOCK).join(classes.select("cid", "n_shingles", "sig").hint("shuffle_hash"), "cid")
    dealt = dealt.select("hub", "block", "visits", "cid", "comp", "n_shingles", "sig").repartition("hub", "block").sortWithinPartitions("hub", "block", "visits")
    return dealt.mapInArrow(_by_block(settle, ["hub", "cid"]), "hub long, cid long").distinct()


def _by_block(settle, names: list[str]):
    """A task that reads sorted rows (hub, block, visits, ...): it holds the home rows of a block while the visitors pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_hashes()
        rows = (row for batch in batches for low in range(0, batch.num_rows, 256) for row in zip(*(c.to_pylist() for c in batch.slice(low, 256).columns)))
        out = []
        for (hub, _), block in groupby(rows, lambda r: r[:2]):
            home = []
            for row in block:
                if row[2]:
                    if home:
                        out += settle(hub, home, (r[3:] for r in chain([row], block)))
                    break
                home.append(row[3:])
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names)

    return run


def _linked(members: DataFrame, classes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links between different components, confirmed on the full sets, as many as connect what is linked in a block."""
    percent = round(similarity * 100)

    def settle(hub: int, home: list[tuple], visitors: Iterator[tuple]) -> Iterator[tuple]:
        cids, comps, sizes, sigs, held = zip(*home)
        own, comps, sets = Signatures(sigs, sizes, similarity), np.array(comps), {}
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                parent[c] = c = parent.get(parent[c], parent[c])
            return c

        for cid, comp, size, sig, text in visitors:
            one, mine = Signatures([sig], [size], similarity), None
            for at in own.like(one.values[0], size, np.flatnonzero(comps != comp)).tolist():
                a, b = root(comp), root(int(comps[at]))
                if a == b:
                    continue
                mine = shingle_set(text, words) if mine is None else mine
                if at not in sets:
                    sets[at] = shingle_set(held[at], words)
                common = len(np.intersect1d(mine, sets[at], assume_unique=True))
                if 100 * common >= percent * (len(mine) + len(sets[at]) - common):
                    parent[a] = b
                    yield cid, cids[at]

    dealt = _dealt(members, TEXT_BLOCK).join(classes.select("cid", "n_shingles", "sig").hint("shuffle_hash"), "cid").join(texts.hint("shuffle_hash"), "cid")
    dealt = dealt.select("hub", "block", "visits", "cid", "comp", "n_shingles", "sig", "text").repartition("hub", "block").sortWithinPartitions("hub", "block", "visits")
    return dealt.mapInArrow(_by_block(settle, ["a", "b"]), "a long, b long")


def _texts(docs: DataFrame, classes: DataFrame, cids: DataFrame) -> DataFrame:
    """(cid, text) written, for the classes of `cids`."""
    needed = classes.join(cids.distinct().hint("shuffle_hash"), "cid", "left_semi").select("cid", F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"))
    whole = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("row_key"), "text")
    same = whole["doc_id"].eqNullSafe(F.col("_id")) & (whole["row_key"] == F.col("_key"))
    # A repeated row gives its class the same text twice, which only repeats a test.
    return written(whole.join(needed.hint("shuffle_hash"), same).select("cid", "text"), "texts")


def links(docs: DataFrame, classes: DataFrame, stars: DataFrame, tested: DataFrame, words: int, similarity: float) -> DataFrame:
    """(cid, component) of classes linked with others: first by tests against hubs, then between what these left apart."""
    texts = _texts(docs, classes, tested.select(F.explode(F.array("a", "b")).alias("cid")))
    first = written(_confirmed(tested, texts, words, similarity), "links")
    parts = connected_components(first, "a", "b")
    apart = written(_unsettled(stars, parts), "apart")
    found = _partnered(apart, classes, similarity)
    left = written(apart.join(found, ["hub", "cid"], "left_semi"), "partnered")
    # Among those left the largest component is another one, and the blocks are fewer.
    sizes = left.groupBy("hub", "comp").agg(F.count(F.lit(1)).alias("m"))
    most = sizes.groupBy("hub").agg(F.sum("m").alias("n"), F.max(F.struct("m", "comp")).alias("most")).select("hub", "n", F.col("most.comp").alias("largest"))
    left = left.select("hub", "cid", "comp").join(most.hint("shuffle_hash"), "hub").select("hub", "n", "cid", "comp", (F.col("comp") != F.col("largest")).alias("minor"))
    more = written(_linked(left, classes, _texts(docs, classes, left.select("cid")), words, similarity), "more-links")
    return connected_components(first.unionByName(more), "a", "b")


def _labelled(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, row_key, n_shingles, component, component_id, best): component is null for a text without words.

    `best` is the row of the component that stays: the smallest (doc_id is null, doc_id, row_key).
    """
    rows = written(signatures(docs, words), "signatures")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row_key", "n_shingles", "sig"))
    classes = rows.where("set_key is not null").groupBy("set_key").agg(best.alias("best"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "set_key", "best.doc_id", "best.row_key", "best.n_shingles", "best.sig"), "classes")
    stars, tested = candidates(classes, written(postings(classes), "postings"), similarity)
    linked = links(docs, classes, stars, tested, words, similarity)

    parts = classes.select("cid", "set_key", "doc_id", "row_key").join(linked.select(F.col("node").alias("cid"), "component").hint("shuffle_hash"), "cid", "left")
    parts = parts.withColumn("component", F.coalesce("component", "cid"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("best")
    names = parts.groupBy("component").agg(F.min("doc_id").alias("component_id"), first)
    labels = parts.join(names.hint("shuffle_hash"), "component").select("set_key", "component", "component_id", "best")
    return rows.select("doc_id", "row_key", "n_shingles", "set_key").join(labels.hint("shuffle_hash"), "set_key", "left").drop("set_key")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id, kept), one row per row of `docs`."""
    found = _labelled(docs, words, similarity)
    name = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "row_key", "n_shingles", name.alias("component_id"), F.col("doc_id").eqNullSafe(name).alias("kept"))


def near_dedup_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one document of each component, columns as given; the pipeline's stage.

    One row stays, the smallest by doc_id (null last) and then by a hash of the text and of its other columns, also if all rows
    of a component have no doc_id or several have its smallest one. Texts without words are linked with nothing and all stay.
    """
    found = _labelled(docs, words, similarity).where("component is not null")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row_key") == F.col("best.row_key"))
    losers = written(found.where(~stays).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct(), "losers")
    marked = sealed(docs).withColumn("_row", F.xxhash64(text_or_empty()))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_key"))
    left = marked.join(losers.hint("shuffle_hash"), same, "left_anti")
    copies = Window.partitionBy("doc_id", "_row").orderBy(F.xxhash64("_rest"))
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return unsealed(left.withColumn("_place", F.row_number().over(copies)).where((F.col("_place") == 1) | wordless), docs.columns)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), words=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words
), sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
tokens AS (SELECT doc_id, n, hash(unnest(s)) AS t FROM sized),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS inter
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY ALL
), link AS (
  SELECT a, b FROM common WHERE 100 * inter >= 80 * (na + nb - inter)
), edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM sized UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
named AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, s.n AS n_shingles, n.component_id, s.doc_id = n.component_id AS kept
FROM sized s JOIN named n ON s.doc_id = n.doc_id
"""
