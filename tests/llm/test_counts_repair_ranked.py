"""Token counts, conversation repair and ranked search against the public library and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.llm import ranked, repair, token_counts
from ionloom.llm.pieces import Vocabulary, default_model

SF = "/root/testdata/sf0.001"


# --- token counts ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=default_model())


@pytest.fixture(scope="module")
def machine():
    return token_counts.Transducer(Vocabulary.load(default_model()))


def _odd_texts():
    draw = random.Random(1)
    parts = ["a", "b", "e", "t", "h", "▁", " ", "  ", "=", "0", "1", "é", "\n", "in", "ing", "the", "tion", "🙂", "日", "\0", "<s>", "</s>", "<0x0A>", "<unk>"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(300))) for _ in range(150)]
    ranges = [(32, 127), (32, 1000), (0x4E00, 0x9000), (0x1F300, 0x1F600)]
    texts += ["".join(chr(draw.randrange(*draw.choice(ranges))) for _ in range(draw.randrange(200))) for _ in range(100)]
    return [*texts, "", " ", "a", "\0a", "x" * 5000, " " * 3000, "aaaa" * 900, "▁▁ " * 400, "=" * 2001, "international" * 300, "日本語テキスト🙂" * 80, "\n\t" * 700]


def test_counts_equal_the_library(machine, library):
    texts = _odd_texts()
    assert token_counts.counts_of(machine, texts).tolist() == [len(x) for x in library.encode(texts)]


@pytest.mark.parametrize("chunk, segment, states", [(3, 64, 10), (7, 1 << 12, 50), (64, 256, 10**9)])
def test_counts_do_not_depend_on_the_cuts(monkeypatch, library, chunk, segment, states):
    """Chunks that end inside words and unbroken runs, segments inside texts, tables begun anew."""
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    monkeypatch.setattr(token_counts, "SEGMENT", segment)
    monkeypatch.setattr(token_counts, "STATES", states)
    texts = _odd_texts()[::7] + ["x" * 700, "aaab" * 150, "the thing " * 50]
    own = token_counts.Transducer(Vocabulary.load(default_model()))
    assert token_counts.counts_of(own, texts).tolist() == [len(x) for x in library.encode(texts)]


def test_state_maps_compose_to_what_one_walk_gives():
    draw = random.Random(5)
    step = [[draw.randrange(6) for _ in range(6)] for _ in range(40)]  # one map per chunk over six states
    maps = token_counts.StateMaps(np.r_[3, np.zeros(39, int)], np.array([step[0][3], *[s[0] for s in step[1:]]]))
    while (more := maps.missing()) is not None:
        chunk, states = more
        maps.add(chunk, states, np.array([step[c][s] for c, s in zip(chunk, states)]), None)
    state = 3
    for c in range(40):
        assert maps.entry(c) == state
        state = step[c][state]
    assert maps.end() == state


def test_emitted_tokens_add_up_at_every_prefix(machine, library):
    """The annotations of a path sum up to the count of each prefix, also where they take tokens back."""
    text = "reinternationalisation of▁ 12 ==="
    key, total = machine.step(machine.keys[token_counts.ROOT], "▁")
    for n, char in enumerate(text, 1):
        char = "▁" if char == " " else char
        key, emitted = machine.step(key, char) if ord(char) and machine.classes[ord(char)] >= token_counts._FIRST else (machine.keys[0], 1)
        total += emitted
        assert total == len(library.encode(text[:n]))


def test_token_counts_of_a_table(spark, library):
    texts = [None, "", "one two", "one two", "word " * 5000, *_odd_texts()[:30]]
    rows = [(None if i == 3 else i % 9, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, over_limit int").repartition(3)
    want = [(r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "")), n > 4096) for r in rows]
    got = [tuple(r) for r in token_counts.token_counts(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_op11_on_the_tables(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {d.doc_id: len(library.encode(d.text or "")) for d in docs}
    assert {r.doc_id: r.n_tokens for r in token_counts.op11_token_counts(spark, SF).collect()} == want


# --- conversation repair -----------------------------------------------------------------------------


def _cheapest(rows):
    """All ways at once, as whole strings: rows of (role, text, fault)."""
    names, nxt = {2: "user", 3: "assistant"}, {0: 2, 1: 2, 3: 2, 2: 3}
    keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    def insert(best):
        for _ in range(4):
            for s, t in nxt.items():
                if s in best:
                    cost, audit, out = best[s]
                    way = (cost + 2, audit + "I", (*out, names[t] + ":"))
                    if t not in best or way[:2] < best[t][:2]:
                        best[t] = way
        return best

    best = insert({0: (0, "", ())})
    for role, text, fault in rows:
        new = {}
        for s, (cost, audit, out) in best.items():
            ways = [(s, cost + 3, "D", out)]
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if (role[:1], s) in keep:
                    ways.append((keep[role[:1], s], cost + more, "K", (*out, f"{role}:{text}")))
                ways.append((nxt[s], cost + more + 2, "R", (*out, f"{names[nxt[s]]}:{text}")))
            for t, c, letter, o in ways:
                if t not in new or (c, audit + letter) < new[t][:2]:
                    new[t] = (c, audit + letter, o)
        best = insert(new)
    return min((best[s] for s in (0, 3) if s in best), key=lambda w: w[:2])


def _expected(turns):
    """The contract, plainly: rows of (conv_id, turn, role, text)."""
    found = {}
    for conv, turn, role, text in turns:
        role, text = role if role is not None else " ", text if text is not None else " "
        rows = found.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in found.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for _, role, text in rows:
            last = re.sub("[ \t-\r]", "", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns_ = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns_) - min(turns_) + 1 - len(turns_) if turns_ else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        faults = Counter(f for _, _, f in faulty)
        cost, audit, lines = _cheapest(faulty)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return out


def test_survivors_find_the_least_of_the_cheapest_ways():
    draw = random.Random(3)
    pools = [["user", "assistant"], ["system"], ["user"], ["assistant"], ["system", "user", "assistant", "tool", ""]]
    for _ in range(1500):
        pool = draw.choice(pools)
        rows = [(draw.choice(pool), draw.choice(["a.", "b", "c?"]), draw.choice([None] * 3 + ["truncated", "blank", "duplicate"])) for _ in range(draw.randrange(40))]
        found = repair.Survivors()
        for row in rows:
            found.add(*row)
        cost, audit, out = _cheapest(rows)
        assert found.result() == (cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_survivors_coalesce():
    found, most, letters = repair.Survivors(), 0, 0
    for i in range(20_000):
        found.add("user" if i % 2 == 0 else "assistant", "text.", None if i % 17 else "blank")
        most = max(most, found.unresolved())
        letters += 1
    assert most < 30  # nearly all letters are settled on the way
    assert len(found.emitted) > letters - 30


def test_survivors_that_never_meet_are_compared_whole():
    """Users only: two ways of equal cost differ from the second letter on."""
    found = repair.Survivors()
    for _ in range(5000):
        found.add("user", "text.", None)
    rows = [("user", "text.", None)] * 5000
    cost, audit, _ = _cheapest(rows)
    assert found.result()[:2] == (cost, audit)
    assert found.unresolved() > 5000


def _conversations():
    draw = random.Random(8)
    texts = ["Hello there.", "Hello there", " \t", "", None, "What?\n", "Yes!", "Ünï cödé", "a. b", "long " * 3000 + "."]
    roles = ["user", "assistant", "system", None, "", "tool", "u"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(draw.randrange(1, 12)):
            rows.append((conv, draw.choice([turn, turn, turn, turn * 2, None]), draw.choice(roles[: draw.choice([2, 3, 7])]), draw.choice(texts)))
    rows += [(1000, t, "user" if t % 2 else "assistant", f"turn {t % 5}.") for t in range(400)]  # a long one, many duplicates
    rows += [(1001, 3, "user", "same.")] * 5
    rows += [(c, 0, "user", "gone.") for c in range(2000, 2100)]  # some of these lose their only row
    return rows


def test_repair_equals_the_contract(spark):
    rows = _conversations()
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, copies int, fault string").repartition(5)
    got = [tuple(r) for r in repair.repair(repair.damaged(turns)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, _expected(rows)))
    assert any(g[7] == "" and g[8] == hashlib.sha256(b"").hexdigest() for g in got)
    assert repair.repair(repair.damaged(turns.limit(0))).count() == 0


def test_repair_splits_hot_digests(spark, monkeypatch):
    from ionloom.llm import common

    monkeypatch.setattr(common, "LEAST_ROWS", 20)
    rows = [(5, t, "user", "the same.") for t in range(600)] + [(6, t, "user", f"text {t}.") for t in range(30)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in repair.repair(repair.damaged(turns)).collect()]
    assert sorted(got) == sorted(_expected(rows))


def test_repaired_turns_give_the_digest(spark):
    rows = spark.createDataFrame(_conversations(), "conv_id long, turn long, role string, text string")
    broken = repair.damaged(rows)
    found = repair.repair(broken)
    left = repair.repaired_turns(broken, found)
    lines = {}
    for r in left.orderBy("conv_id", "turn_no").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in found.collect():
        assert hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


# --- ranked search -----------------------------------------------------------------------------------


def _rank(docs, items, top):
    """Every document scored for every item."""

    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    total, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        scored = []
        for doc, c, n in counted:
            m = 50 + (50 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:top], 1)]
    return out


def _corpus(seed=0, size=500):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    common_ = ["the", "of", "And", "in"]
    docs = []
    for i in range(size):
        topic = draw.choices(words[(i % 6) * 40 : (i % 6) * 40 + 60], k=draw.randrange(1, 60))
        docs.append((i, ", ".join(draw.choices(common_, k=20) + topic)))
    docs += [(1000 + i, docs[7][1]) for i in range(80)]  # copies tie
    docs += [(3, "again w1 w2"), (3, "again w1 w2"), (None, "w1 w5 w9"), (None, None), (2000, None), (2001, ""), (2002, " .-! "), (2003, "W1_w2 Ünï日本 É"), (2004, "w1 " * 40_000)]
    items = [(i, " ".join(draw.choices(words, k=8) + draw.choices(common_, k=6))) for i in range(12)]
    items += [(50, docs[7][1]), (51, None), (52, "zzz unknown"), (53, "the"), (54, "w1 w1 W1"), (54, "w2"), (None, "w3 ünï É")]
    return docs, items


@pytest.mark.parametrize("seed, top, chunk, block", [(0, 50, 4096, 64), (1, 5, 32, 4), (2, 1, 100, 1), (3, 1000, 64, 16)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, seed, top, chunk, block):
    monkeypatch.setattr(ranked, "CHUNK", chunk)
    monkeypatch.setattr(ranked, "BLOCK", block)
    monkeypatch.setattr(ranked, "PROBED", 10)
    docs, items = _corpus(seed)
    table = spark.createDataFrame([(*d, 1, "x", 2.0) for d in docs], "doc_id long, text string, n int, terms string, score double").repartition(6)
    queries = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, term string")
    got = [tuple(r) for r in ranked.ranked_search(table, queries, top).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, _rank(docs, items, top)))


def test_ranked_search_in_blocks_of_queries(spark, monkeypatch):
    docs, items = _corpus(4, 120)
    blocks = ranked.query_blocks
    monkeypatch.setattr(ranked, "query_blocks", lambda *a: blocks(*a, limit=30))
    got = ranked.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 7)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, _rank(docs, items, 7)))


def test_ranked_search_on_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.ranked_search(docs.limit(0), items).count() == 0
    assert ranked.ranked_search(docs, items.limit(0)).count() == 0
    assert ranked.ranked_search(docs, items).count() == 1


def test_blocks_are_skipped_and_summaries_bound_them(spark):
    """The summary of a block is the highest impact in each coordinate, and most blocks are not scored."""
    docs, items = _corpus(6, 2000)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    queries = next(ranked.query_blocks(spark.createDataFrame(items[:12], "item_id long, text string"), "text", "item_id"))
    rows = ranked.vectors(table, queries)
    total, length = ranked.statistics(rows, queries)
    queries.set_thresholds(ranked.probe(rows, queries, total, length, 10))
    chunks = ranked.index(ranked.by_likeness(rows, queries, total, length), queries, total, length).collect()
    skipped = blocks = 0
    for row in chunks:
        for k, term in enumerate(row.list_terms):
            for b in range(row.list_starts[k], row.list_starts[k + 1]):
                members = row.members[row.block_starts[b] : row.block_starts[b + 1]]
                summary = dict(zip(row.summary_terms[row.summary_starts[b] : row.summary_starts[b + 1]], row.summary_values[row.summary_starts[b] : row.summary_starts[b + 1]]))
                highest = {}
                for d in members:
                    own = dict(zip(row.terms[row.starts[d] : row.starts[d + 1]], row.counts[row.starts[d] : row.starts[d + 1]]))
                    assert term in own
                    for t, tf in own.items():
                        m = 50 + (50 * row.n[d] * total) // length
                        highest[t] = max(highest.get(t, 0), (1000000000 * tf) // (1000 * tf + 20 * m))
                assert all(highest[t] == v for t, v in summary.items())
                for q in range(len(queries.items)):
                    if term in queries.visited(q):
                        assert set(highest) & set(queries.terms(q).tolist()) <= set(summary)
                        blocks += 1
                        skipped += sum(int(queries.weight[t]) * summary.get(t, 0) for t in queries.terms(q).tolist()) < queries.threshold[q]
    assert skipped > blocks / 4
