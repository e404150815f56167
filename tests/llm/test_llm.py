"""The training-data operators against brute force, on tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionloom.llm import chat, exact_dedup, fingerprint, near_dup, packing, pieces, quality, sharding, substrings, toxicity
from ionloom.llm.shingles import shingle_set

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOCS + ", digest string, id string, _rest int, n int, shard string, part string, row_key string, text_sha256 string"


def _words(n, seed, pool=400):
    draw = random.Random(seed)
    return [f"w{draw.randrange(pool)}" for _ in range(n)]


def _texts():
    base, other = _words(120, 1), _words(120, 2)
    near = base.copy()
    near[60] = "changed"
    return [
        None, "", " \t\n", "one", "ONE", "one ", " ".join(base), " ".join(near), "\n".join(base), " ".join(base).upper(),
        " ".join(other), " ".join(_words(30, 3) + base[20:90] + _words(30, 4)), " ".join(_words(30, 5) + base[20:90]),
        "Ünï  cödé 🙂 " * 5, "x" * 3000, " ".join(_words(5000, 6)), "<|endoftext|> a.", " ".join(other),
    ]


def _rows(clash=False):
    rows = [(i * 3 % 101, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(_texts())]
    rows += [rows[6], rows[6], rows[10]]  # repeated rows
    rows.append((None, "null id " + " ".join(_words(80, 7)), "en", "s", 1))
    return [(*r, "d", "i", 1, 2, "s", "p", "r", "t") for r in rows] if clash else rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(True), EXTRA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- exact dedup -------------------------------------------------------------------------------------


def _norm(text):
    return (text or "").translate({c: None for c in b" \t\n\x0b\x0c\r"})


def _check_exact(found):
    rows = _rows()
    groups = {}
    for r in rows:
        groups.setdefault(_norm(r[1]), []).append(r)
    want = []
    for norm, members in groups.items():
        keep = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, -(r[0] or 0) * -1))[0]
        want += [(r[0], keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for r in members]
    got = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(r.kept for r in found) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


@pytest.mark.parametrize("digest_bytes,batches", [(32, 2), (32, 3), (1, 2)])
def test_exact_dedup(docs, digest_bytes, batches):
    _check_exact(exact_dedup.exact_dedup(docs, batches, digest_bytes, segment_keys=4).collect())


def test_exact_dedup_stage(docs, empty):
    kept = exact_dedup.dedup_documents(docs)
    assert kept.columns == docs.columns
    texts = [_norm(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({_norm(r[1]) for r in _rows()})
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.dedup_documents(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000, 40_000])
def test_fuse_filter(n):
    draw = np.random.default_rng(n)
    keys, others = draw.integers(0, 2**64, n, np.uint64), draw.integers(0, 2**64, 100_000, np.uint64)
    made = exact_dedup.FuseFilter.build(np.r_[keys, keys[:5]])
    assert made.contains(keys).all()
    assert made.contains(others).mean() < 0.01
    assert n < 3000 or len(made.table) < 1.4 * n


# --- near duplicates ---------------------------------------------------------------------------------


def _components(rows, words, similarity=0.8):
    sets = [set(shingle_set(r[1], words).tolist()) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-12:
                parent[root(i)] = root(j)
    names = {}
    for i, r in enumerate(rows):
        if sets[i] and r[0] is not None:
            names[root(i)] = min(names.get(root(i), r[0]), r[0])
    return [(r[0], len(sets[i]), names.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


def _check_near(found, rows, words):
    got = sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in found)
    assert got == sorted(map(repr, _components(rows, words)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(docs, words):
    _check_near(near_dup.near_duplicates(docs, words).collect(), _rows(), words)


def test_near_duplicates_in_crowds(spark, monkeypatch):
    """Hundreds of near copies around several texts, chains at the threshold, compared in small blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "TEXT_BLOCK", 3)
    draw, rows = random.Random(5), []
    for base in range(4):
        words = _words(60, 100 + base)
        for i in range(60):
            own = words.copy()
            for at in draw.sample(range(60), draw.randrange(1, 9)):
                own[at] = f"z{draw.randrange(50)}"
            rows.append((base * 1000 + i, " ".join(own), "en", "s", 1))
    _check_near(near_dup.near_duplicates(spark.createDataFrame(rows, DOCS), 2).collect(), rows, 2)


def test_near_copies_among_half_alike_texts(spark):
    """One pair of near copies in each family of texts that share most passages, so that their hubs are other texts."""
    rows = []
    for seed in (1, 8, 11, 14):
        draw = random.Random(seed)
        passages = [[f"f{seed}p{p}w{i}" for i in range(5)] for p in range(120)]
        texts = [[w for p in sorted(draw.sample(range(120), 66)) for w in passages[p]] for _ in range(100)]
        near = texts[50].copy()
        for at in draw.sample(range(len(near)), 14):
            near[at] = f"changed{at}"
        rows += [(seed * 1000 + i, " ".join(t), "en", "s", 1) for i, t in enumerate([*texts, near])]
    assert sum(c != d for d, _, c in _components(rows, 2)) == 4
    _check_near(near_dup.near_duplicates(spark.createDataFrame(rows, DOCS), 2).collect(), rows, 2)


def test_near_dedup_stage(docs, empty):
    kept = near_dup.near_dedup_documents(docs)
    assert kept.columns == docs.columns
    want = {repr(c) for d, n, c in _components(_rows(), 5) if n}
    got = [r for r in kept.collect() if shingle_set(r.text, 5).size]
    assert {repr(r.doc_id) for r in got} == want and len(got) == len(want)
    assert near_dup.near_duplicates(empty).count() == 0


def test_dedup_stages_leave_one_row_of_null_and_repeated_ids(spark):
    """Components whose rows have no id, or share the smallest one; equal texts of one id that differ in white space."""
    base = _words(60, 77)
    near = [" ".join([*base[:-1], w]) for w in ("x", "y", "z")]
    rows = [(None, near[0], "en", "a", 1), (None, near[1], "en", "b", 1), (None, near[1], "en", "c", 1)]
    other = _words(60, 78)
    rows += [(5, " ".join([*other[:-1], "x"]), "en", "a", 1), (5, " ".join([*other[:-1], "y"]), "en", "a", 1), (9, " ".join(other), "en", "a", 1)]
    rows += [(7, None, "en", "a", 1), (7, "", "en", "a", 1), (8, " ", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    left = near_dup.near_dedup_documents(docs).collect()
    assert sorted(repr(r.doc_id) for r in left) == sorted(map(repr, [None, 5, 7, 7, 8]))
    again = near_dup.near_dedup_documents(docs.repartition(2)).collect()
    assert sorted(map(repr, left)) == sorted(map(repr, again))
    spaced = spark.createDataFrame([(3, "a b", "en", "s", 1), (3, "a  b ", "en", "t", 1), (3, "a  b ", "en", "u", 1), (4, "ab", "en", "s", 1), (None, "c", "en", "s", 1), (None, "c ", "en", "s", 1)], DOCS)
    kept = exact_dedup.dedup_documents(spaced).collect()
    assert sorted(repr((r.doc_id, r.text)) for r in kept) == ["(3, 'a  b ')", "(None, 'c ')"]


def test_shingles():
    assert len(shingle_set("a b a b a", 2)) == 2
    assert len(shingle_set("one", 2)) == 1 and len(shingle_set(" \n", 2)) == 0 and len(shingle_set(None, 2)) == 0
    assert (shingle_set("A b", 2) == shingle_set("a\x0bB", 2)).all()
    assert not (shingle_set("É b", 2) == shingle_set("é b", 2)).all()  # only A-Z fold
    assert len(shingle_set("a\xa0b", 2)) == 1  # only ASCII white space parts words


# --- substrings --------------------------------------------------------------------------------------


def _removed(rows, window):
    owner = {}
    keyed = [(2**63 - 1 if r[0] is None else r[0], (r[1] or "").encode().split()) for r in rows]
    for doc_id, words in keyed:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            owner[key] = min(owner.get(key, doc_id), doc_id)
    out = []
    for (doc_id, words), r in zip(keyed, rows):
        gone = set()
        for i in range(len(words) - window + 1):
            if owner[tuple(words[i : i + window])] < doc_id:
                gone |= set(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((r[0], len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window,minimiser,bucket", [(50, 8, 20_000), (50, 8, 1), (10, 3, 2), (8, 8, 20_000)])
def test_substrings(docs, window, minimiser, bucket):
    found = substrings.removal_report(docs, window, minimiser, bucket).collect()
    got = sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in found)
    assert got == sorted(map(repr, _removed(_rows(), window)))


def test_runs_of_a_document_make_one_row_of_spans():
    """Each run made rows of its own, hundreds for a document that holds a common passage."""
    runs = [{"first": 6, "gone": [True, True]}, {"first": 0, "gone": [False, True]}, {"first": 2, "gone": [True]}, {"first": 8, "gone": [True, False]}]
    kind = pa.list_(pa.struct([("first", pa.int32()), ("gone", pa.list_(pa.bool_()))]))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([9]), pa.array([runs], kind)], ["id", "row_key", "runs"])
    made = [row for out in substrings._spans([batch]) for row in out.to_pylist()]
    assert made == [{"id": 7, "row_key": 9, "spans": [{"lo": 1, "windows": 2}, {"lo": 6, "windows": 3}]}]


def test_equal_runs_of_a_document_travel_as_one_row(spark):
    passage = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(passage)), (2, " ".join(["x", *passage * 40]))]
    docs = substrings._keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    suspects, _ = substrings.repeated_windows(docs, 50, 8)
    runs = {r.id: len(r.runs) for r in suspects.collect()}
    packed = [r for r in substrings._packed(suspects, 50).collect() if r.id == 2]
    assert len(packed) < 10 < runs[2] == sum(len(r.firsts) for r in packed)
    words = rows[1][1].encode().split()
    for r in packed:
        own = r.packed.split(b" ")
        assert all(words[first : first + len(own)] == own for first in r.firsts)
    found = substrings.removal_report(docs.select("doc_id", "text")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == sorted(_removed(rows, 50))


def test_a_repeated_passage_makes_one_row_per_minimiser(spark):
    """The join of runs and shared minimisers read a row per run, hundreds of them for one passage."""
    passage = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(passage)), (2, " ".join(["x", *passage * 40])), (2, " ".join(["x", *passage * 40])), (3, "short"), (None, None)]
    docs = substrings._keyed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    runs = substrings._doc_runs(docs, 50, 8).collect()
    keys, first, sizes = substrings.super_kmers(rows[1][1].encode().split(), 50, 8)
    own = [r for r in runs if r.id == 2]
    assert len(own) == 2 * len(set(keys.tolist())) < len(keys)  # the row is there twice
    got = sorted((r.minimiser, f, n) for r in own for f, n in zip(r.firsts, r.windows))
    assert got == sorted(2 * list(zip(keys.tolist(), first.tolist(), sizes.tolist())))
    assert {r.id for r in runs} == {1, 2}
    suspects, _ = substrings.repeated_windows(docs, 50, 8)
    held = [sorted((x.minimiser, x.first, x.windows) for x in r.runs) for r in suspects.collect() if r.id == 2]
    shared = {r.minimiser for r in runs if r.id == 1}
    assert held == 2 * [sorted(x for x in zip(keys.tolist(), first.tolist(), sizes.tolist()) if x[0] in shared)]
    found = substrings.removal_report(docs.select("doc_id", "text")).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in found) == sorted(map(repr, _removed(rows, 50)))


def test_substring_stage(docs, empty):
    cut = substrings.substring_dedup_documents(docs)
    assert cut.columns == docs.columns
    want = [w for w in _removed(_rows(), 50) if w[1] == 0 or w[2] < w[1]]
    got = [(r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in cut.collect()]
    assert sorted(map(repr, got)) == sorted(repr((w[0], w[3])) for w in want)
    assert substrings.removal_report(empty).count() == 0 and substrings.substring_dedup_documents(empty).count() == 0


# --- packing -----------------------------------------------------------------------------------------


def test_packing(docs, empty):
    tokenizer = packing.word_ids(packing.default_vocabulary()).tokenizer
    found = packing.pack_documents(docs, capacity=64).collect()
    want = []
    for doc_id, text, *_ in _rows():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 64)):
            own = ids[at : at + 64]
            want.append((doc_id, piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(repr(tuple(r)[:5]) for r in found) == sorted(map(repr, want))
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 64
    assert len(bins) <= -(-sum(r.length for r in found) // 64) + 3
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    draw = np.random.default_rng(seed)
    lengths = draw.integers(1, 101, draw.integers(1, 400))
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    bins, placed = {}, {}
    for length, first, n, start, each, place in packing.plan_bins(counts, 100):
        placed[length] = placed.get(length, 0) + n
        for i in range(n):
            bins.setdefault(start + i // each, []).append((place + i % each * length, length))
    assert placed == counts
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 100
        assert sum(3 * n > 100 for _, n in own) <= 2
    assert len(bins) <= 11 * -(-lengths.sum() // 100) // 9 + 5


def test_word_ids():
    encoder = packing.word_ids(packing.default_vocabulary())
    texts = ["a<|endoftext|>b <|ENDOFTEXT|>. X!! It's DON'T. don't, we'll... ÉTÉ, x1. 2,, \t z.İs ΣΟΣ. ''s. x's' 's, a\xa0b. ﬁ. ²."]
    ids = encoder.tokenizer.encode(texts[0], add_special_tokens=False).ids
    assert np.frombuffer(encoder.of(texts)[0], "<u4").tolist() == ids


# --- sharding ----------------------------------------------------------------------------------------


def test_sharding(spark, docs, empty):
    rows = spark.range(997).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("part"), F.lit("old").alias("shard"))
    for partition_rows in (10_000, 60):
        found = sharding.shard(rows, ["doc_id"], 24, 1, partition_rows).toPandas()
        sizes = found.groupby("shard").slot.agg(["count", "max", "nunique"])
        assert found.doc_id.nunique() == 997 and set(sizes["count"]) <= {41, 42}
        assert (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all()
    spread = found.doc_id.corr(found.shard * 1000 + found.slot)
    assert abs(spread) < 0.15
    assert sharding.shard(docs.select("doc_id", "n_chars"), ["doc_id", "n_chars"]).count() == len(_rows())
    assert sharding.shard(empty, ["doc_id"]).count() == 0


@pytest.mark.parametrize("total,marked,drawn", [(100, 30, 20), (100, 80, 70), (10**10, 4 * 10**8, 10**9), (5, 5, 3), (7, 0, 3)])
def test_hypergeometric(spark, total, marked, drawn):
    numbers = [F.lit(x).cast("long") for x in (total, marked, drawn)]
    k = spark.range(2000).select(sharding.hypergeometric(*numbers, 3, F.col("id")).alias("k")).toPandas().k
    mean, share = drawn * marked / total, marked / total
    variance = drawn * share * (1 - share) * (total - drawn) / (total - 1)
    assert abs(k.mean() - mean) <= 5 * (variance / 2000) ** 0.5
    assert k.min() >= max(0, drawn + marked - total) and k.max() <= min(marked, drawn)
    assert variance == 0 or 0.8 < k.var() / variance < 1.2


# --- fingerprints ------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk_rows", [2, 1000])
def test_fingerprints(docs, empty, chunk_rows):
    found = {(r.doc_id, r.n_chars, r.fingerprint): r for r in fingerprint.fingerprint_report(docs, chunk_rows).collect()}
    rows = sorted({r[0]: r for r in _rows()}.values(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(found) == len({(r[0], r[1]) for r in _rows()})
    for r, following in zip(rows, rows[1:] + rows[:1]):
        text, after = r[1] or "", following[1] or ""
        own = found[r[0], len(text), fingerprint.Fingerprint.of(text).hex()]
        if [x[0] for x in _rows()].count(r[0]) == 1:
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half] if half else text
            assert own.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert own.edited_fingerprint == fingerprint.Fingerprint.of(edited).hex()
    assert fingerprint.fingerprint_report(empty).count() == 0


def test_likeness_of_a_word_repeated_often():
    half, often = (fingerprint.Fingerprint.of("again " * n) for n in (35_000, 70_000))
    assert abs(half.likeness(often) - (1 - 1 / 5)) < 1e-3
    assert often.delete(["again " * 70_000]).hex() == fingerprint.Fingerprint().hex()


def test_fingerprint_algebra():
    a, b, c = ["x y z\n"], ["p q\n", "p q\n"], ["tail"]
    whole = fingerprint.Fingerprint().insert(a + b + c)
    assert whole.hex() == fingerprint.Fingerprint().insert(c + b + a).hex()
    assert whole.delete(b).hex() == fingerprint.Fingerprint().insert(a + c).hex()
    assert whole.hex() != fingerprint.Fingerprint().insert(a + b[:1] + c).hex()
    nothing = fingerprint.Fingerprint.of("")
    assert nothing.likeness(nothing) == 1 and nothing.likeness(whole) == 0 and whole.likeness(whole) == 1
    text = " ".join(_words(400, 9, 5000))
    assert fingerprint.Fingerprint.of(text).likeness(fingerprint.Fingerprint.of(text[:-200])) > 0.8
    assert fingerprint.Fingerprint.of(text).likeness(fingerprint.Fingerprint.of(" ".join(_words(400, 10, 5000)))) < 0.3


# --- chats -------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    texts = ["plain", "", None, "\\", "a\\<s>\\\\", *chat.CONTROLS, *["\\" + c for c in chat.CONTROLS], "<\\s>", "x" * 5000, "🙂</s>\n<|turn|>user<|text|>\n"]
    turns = [(i % 5, i, ["user", "assistant", "system", None, "<s>"][i % 5 if i % 7 else 1], t) for i, t in enumerate(texts)]
    turns += [(None, 0, "user", "no id"), (9, 0, "user", "same"), (9, 0, "user", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    found = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert set(found) == {0, 1, 2, 3, 4, 9, None}
    for conv in found:
        own = sorted([t for t in turns if t[0] == conv], key=lambda t: t[1])
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        row = found[conv]
        assert row.n_turns == len(own) and row.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert row.loss_chars == len(loss) and row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    rendered = "".join(r.formatted for r in chat.format_chats(df.where("conv_id = 0")).collect())
    assert found[0].formatted_chars == len(rendered) and rendered.startswith(chat.BEGIN)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_log(spark):
    events = [
        (1, 0, "open", "user", None), (1, 1, "delta", None, "hel"), (1, 2, "delta", None, "lo"), (1, 3, "open", "assistant", None),
        (1, 4, "delta", None, "bad"), (1, 5, "regenerate", None, None), (1, 6, "delta", None, "good"), (1, 7, "edit", None, "best"), (2, 0, "delta", None, "stray"),
    ]
    log = spark.createDataFrame(events, "conv_id long, seq long, kind string, role string, payload string").repartition(5)
    got = sorted((r.conv_id, r.turn_no, r.role, r.text) for r in chat.reconstruct(log).collect())
    assert got == [(1, 0, "user", "hello"), (1, 1, "assistant", "best"), (2, 0, "", "stray")]


# --- SentencePiece -----------------------------------------------------------------------------------


def test_sentencepiece_encodes_and_decodes_in_one_worker(spark, tmp_path):
    """Two Python steps in a row were two workers per core, with a vocabulary each."""
    rows = [(i, f"The river rose {i} feet, they said." * (i % 4)) for i in range(40)] + [(40, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = pieces.op4_sentencepiece(spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = sorted((r.doc_id, r.n_ids - len(r.ids), r.decoded_sha256) for r in found.collect())
    assert got == [(i, 0, hashlib.sha256((text or "").encode()).hexdigest()) for i, text in rows]


def test_sentencepiece(spark, docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    odd = ["  a  b\nc  ", "   ", "▁x▁▁ y", "Ａﬁ\t x\xa0y", "a" * 500, "中文 混排，テスト 🙂🙂", "x     y" + " " * 40]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    encoded = pieces.encode(both, size=300)
    want = [(r[0], model.encode(r[1] or "")) for r in _rows()] + [(1000 + i, model.encode(t)) for i, t in enumerate(odd)]
    assert sorted(repr((r.doc_id, list(r.ids))) for r in encoded.collect()) == sorted(map(repr, want))
    texts = [(r[0], r[1] or "") for r in _rows()] + [(1000 + i, t.replace("▁", " ")) for i, t in enumerate(odd)]
    assert sorted(repr((r.doc_id, r.text)) for r in pieces.decode(encoded).collect()) == sorted(map(repr, texts))
    assert pieces.encode(empty, size=10).count() == 0


def test_units_are_cut_where_no_piece_spans(monkeypatch):
    """Each spelling of a word with signs around it was a unit of its own, merged and remembered one by one."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    vocabulary = pieces.Vocabulary.load(pieces.default_model())
    texts = ["", "thernted!& thernted###, thernted%?\n thernted", "(été) «été»…\x01 é!\x01", "▁a▁▁ b", " ", "🙂zqx. 🙂"]
    units, offsets = pieces.split_units(pa.array(texts), vocabulary.borders)
    own = [units[a:b].to_pylist() for a, b in zip(offsets, offsets[1:])]
    marked = [(" " if t else "") + t.replace("▁", " ") for t in texts]
    assert ["".join(u) for u in own] == marked and "" not in units.to_pylist()
    for text in own:
        assert not any((a[-1] + b[0]).replace(" ", "▁") in vocabulary.pairs for a, b in zip(text, text[1:]))
    assert sum("thernted" in u for u in set(own[1])) == 1
    asked = []
    merge_many = pieces.Vocabulary.merge_many
    monkeypatch.setattr(pieces.Vocabulary, "merge_many", lambda self, rare: asked.extend(rare.to_pylist()) or merge_many(self, rare))
    encoder = pieces.UnitIds(vocabulary, {})
    for part in (texts, texts[::-1]):
        ids, ends = encoder.of(pa.array(part))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == model.encode(part)
    assert sorted(asked) == sorted(set(units.to_pylist()))


def test_ids_of_many_units_with_equal_scores():
    """Of pairs with equal scores the leftmost is merged, as one by one."""
    draw = random.Random(5)
    table = {c: (i, 0.0) for i, c in enumerate("abc")}
    for _ in range(30):
        piece = "".join(draw.choice("abc") for _ in range(draw.randrange(2, 5)))
        table.setdefault(piece, (len(table), -float(draw.randrange(4))))
    vocabulary = pieces.Vocabulary(table, [], 99)
    units = ["".join(draw.choice("abcx" if i % 5 == 0 else "abc") for _ in range(draw.randrange(1, 30))) for i in range(400)]
    ids, counts = vocabulary.merge_many(pa.array(units))
    ends = np.cumsum(counts)
    assert [ids[b - n : b].tolist() for b, n in zip(ends, counts)] == [vocabulary.merge(u) for u in units]
    assert [len(x) for x in pieces.Vocabulary({"a": (0, 0.0)}, [], 9).merge_many(pa.array([], pa.string()))] == [0, 0]


def test_viterbi(spark):
    """The best sum of scores, against all segmentations."""
    draw = random.Random(3)
    table = {"".join(draw.choice("abc") for _ in range(draw.randrange(1, 4))): -draw.random() * 5 for _ in range(14)}
    vocabulary = pieces.Vocabulary({p: (i, s) for i, (p, s) in enumerate(table.items())}, [])
    units = sorted({"".join(draw.choice("abcx") for _ in range(draw.randrange(1, 8))) for _ in range(25)})

    def best(unit):
        worst = min([table[unit[i:j]] for i in range(len(unit)) for j in range(i + 1, len(unit) + 1) if unit[i:j] in table], default=0) - 10
        state = [0.0]
        for e in range(1, len(unit) + 1):
            state.append(max([state[s] + table[unit[s:e]] for s in range(e) if unit[s:e] in table] + [state[e - 1] + worst]))
        return state[-1], worst

    df = spark.createDataFrame([(u,) for u in units], "unit string")
    for r in pieces.encode_units(df, vocabulary, "viterbi").collect():
        score, worst = best(r.unit)
        assert "".join(r.unit[s.s : s.e] for s in r.spans) == r.unit
        assert sum(table[r.unit[s.s : s.e]] if i >= 0 else worst for s, i in zip(r.spans, r.ids)) == pytest.approx(score)


# --- classifiers -------------------------------------------------------------------------------------


def test_quality(spark, docs, empty):
    draw = random.Random(1)
    rows = [(i, " ".join(_words(80, i)) if i % 3 else " ".join(w.upper() + "!!" for w in _words(draw.randrange(20, 90), i)), "en", "s", 1) for i in range(240)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(160)] + [(10**6, 1)], "doc_id long, label int")
    measures = quality.measured(df)
    model = quality.fit_on(measures, labels)
    got = {r.doc_id: r.predicted for r in quality.scored(measures, model).collect()}
    assert np.mean([got[i] == (i % 3 > 0) for i in range(160, 240)]) > 0.95
    odd = quality.scored(quality.measured(docs), model).toPandas()
    assert len(odd) == len(_rows()) and odd.score.between(0, 1).all()
    kept = quality.quality_filter(docs, labels)
    assert kept.columns == docs.columns
    nothing = quality.fit_on(measures, labels.limit(0))
    assert set(quality.scored(measures, nothing).toPandas().score) == {0.5}
    assert quality.scored(quality.measured(empty), model).count() == 0


def test_toxicity_counterfactual(spark, docs, empty):
    """A group that is named in toxic texts only must not raise the score of neutral mentions."""
    rows, labels = [], []
    for i in range(400):
        words = _words(40, i, 3000)
        toxic = i % 4 == 0
        if toxic:
            words[5:7] = [["idiot", "moron", "scum"][i % 3], "muslim" if i % 8 == 0 else "thing"]
        elif i % 16 == 1:
            words[5] = "christian"
        rows.append((i, " ".join(words) + ".", "en", "s", 1))
        labels.append((i, int(toxic)))
    df, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, label int")
    biased, fair = (toxicity.fit_on(df, labels.where("doc_id < 300"), strength=s) for s in (0.0, toxicity.COUNTERFACTUAL))
    neutral = " ".join(_words(40, 9999, 3000)) + " a muslim family"
    assert biased.scorer()(neutral) - biased.scorer()(neutral.replace("muslim", "person")) > 0.05
    assert abs(fair.scorer()(neutral) - fair.scorer()(neutral.replace("muslim", "person"))) < 0.02
    got = toxicity.scored(df.withColumn("held_out", F.lit(True)), fair).toPandas().set_index("doc_id").predicted
    assert np.mean([got[i] == (i % 4 == 0) for i in range(300, 400)]) > 0.95
    odd = toxicity.scored(docs.withColumn("held_out", F.lit(True)), fair).toPandas()
    assert len(odd) == len(_rows()) and odd.score.between(0, 1).all()
    nothing = toxicity.fit_on(df, labels.limit(0))
    assert nothing.scorer()("any") == 0.5
    assert toxicity.scored(empty.withColumn("held_out", F.lit(True)), fair).count() == 0


def test_pipeline(spark, tmp_path):
    """Every stage against brute force on the rows that it was given."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], folder).write.parquet(f"{tmp_path}/{len(tables)}")
        tables.append(spark.read.parquet(f"{tmp_path}/{len(tables)}"))
    assert all(t.columns == docs.columns for t in tables[:-1])
    raw, good, exact, near, cut, packed = (t.collect() for t in tables)
    assert 0.6 * len(raw) < len(good) < len(raw)
    assert sorted(_norm(r.text) for r in exact) == sorted({_norm(r.text) for r in good})
    want = {c if n else d for d, n, c in _components([tuple(r) for r in exact], 5)}
    assert {r.doc_id for r in near} == want and len(near) == len(want)
    removed = {w[0]: w for w in _removed([tuple(r) for r in near], 50)}
    left = {r.doc_id: r for r in cut}
    assert set(left) == {d for d, w in removed.items() if w[1] == 0 or w[2] < w[1]}
    assert all(hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == removed[d][3] and r.n_chars == len(r.text or "") for d, r in left.items())
    assert {r.doc_id for r in packed} == set(left)
