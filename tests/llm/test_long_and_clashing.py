"""Texts far longer than those of the tables, and columns with the names that operators use themselves."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.llm import chat, exact_dedup, fingerprint, near_dup, packing, pieces, quality, ranked, repair, sharding, substrings, token_counts, toxicity

COLUMNS = (
    "doc_id long, text string, digest string, id string, _rest int, n int, shard string, part string, row_key string, ids string, unit string, size int, "
    "cid int, hub int, token int, score double, terms string, n_tokens string, kept string, _place int, _row string, component string"
)


def _long_texts():
    draw = random.Random(2)
    words = [f"w{draw.randrange(3000)}" for _ in range(60_000)]
    changed = words.copy()
    changed[30_000] = "changed"
    return [" ".join(words), " ".join(changed), " ".join(words[10_000:10_200]), "x" * 300_000, "日本" * 50_000, "a b\n" * 30_000, " " * 100_000, None, ""]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "d", "i", 1, 2, "s", "p", "r", "x", "u", 3, 4, 5, 6, 0.5, "t", "n", "k", 1, "r", "c") for i, t in enumerate(_long_texts())]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_tokens_of_long_texts(docs, library):
    texts = [t or "" for t in _long_texts()]
    ids = library.encode(texts)
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()} == {i: len(x) for i, x in enumerate(ids)}
    encoded = pieces.encode(docs, size=50)
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == dict(enumerate(ids))
    decoded = {r.doc_id: r.text for r in pieces.decode(encoded).collect()}
    assert decoded == {i: library.decode(x) for i, x in enumerate(ids)}


def test_packing_of_long_texts(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for i, t in enumerate(_long_texts())}
    rows = packing.pack_documents(docs).collect()
    for i, ids in want.items():
        own = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == i)
        assert sum(n for *_, n in own) == len(ids) and [s for _, s, _ in own] == list(range(0, len(ids), packing.CAPACITY))
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1].tolist()] and ends[-1] <= packing.CAPACITY


def test_dedup_of_long_texts(docs):
    near = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, 5).collect()}
    assert near[0] == near[1] == 0 and near[3] == 3 and near[7] == 7
    assert near_dup.near_dedup_documents(docs).columns == docs.columns
    exact = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs).collect()}
    assert exact[6] == exact[7] == exact[8] == 6 and exact[1] == 1
    assert exact_dedup.dedup_documents(docs).columns == docs.columns
    left = {r.doc_id: r.text for r in substrings.substring_dedup_documents(docs).collect()}
    assert len(left[0].split()) == 60_000 and 2 not in left and "changed" in left[1].split()


def test_the_rest_on_long_texts(spark, docs):
    assert fingerprint.fingerprint_report(docs).count() == 9
    measures = quality.measured(docs)
    labels = spark.createDataFrame([(0, 1), (3, 0), (1, 1), (4, 0), (6, 0), (2, 1)], "doc_id long, label int")
    assert quality.scored(measures, quality.fit_on(measures, labels)).count() == 9
    model = toxicity.fit_on(docs, labels)
    assert toxicity.scored(docs.withColumn("held_out", F.lit(True)), model).count() == 9
    placed = sharding.shard(docs.select("doc_id", "text", "shard", "part"), ["doc_id"], 4)
    assert placed.count() == 9
    items = spark.createDataFrame([(1, "w1 w2", 0.5)], "item_id long, text string, score double")
    found = ranked.ranked_search(docs, items, 3).collect()
    assert [(r.rank, r.doc_id) for r in sorted(found, key=lambda r: r["rank"])] and all(r.doc_id in (0, 1, 2) for r in found)


def test_conversations_with_long_texts_and_clashing_columns(spark):
    long_text = "word " * 200_000 + "end."
    rows = [(1, 0, "user", "hi.", "x", 1, "f"), (1, 1, "assistant", long_text, "x", 1, "f"), (2, 0, "user", "z" * 500_000, "x", 1, "f")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault string, copies int, formatted string")
    read = {r.conv_id: r for r in chat.read_back(chat.format_chats(turns.select("conv_id", "turn", "role", "text", "formatted", "fault"))).collect()}
    assert read[1].loss_chars == len(long_text) and read[1].loss_sha256 == hashlib.sha256(long_text.encode()).hexdigest() and read[2].n_turns == 1
    got = {r.conv_id: r for r in repair.repair(turns.withColumn("copies", F.lit(1))).collect()}
    assert got[1].audit == "KK" and got[1].repaired_sha256 == hashlib.sha256(f"user:hi.\nassistant:{long_text}".encode()).hexdigest()
    assert (got[2].truncated, got[2].cost, got[2].audit) == (1, 3, "D")
