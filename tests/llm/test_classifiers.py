"""The classifiers against plain versions of what they compute, on the given tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.llm import quality, sharding, toxicity

SF = "/root/testdata/sf0.01"


def _labelled(spark, label, folds, part):
    """Rows (doc_id, text, label), for learning and held out."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels.select("doc_id", F.col(label).alias("label")), "doc_id").select("doc_id", "text", "label").orderBy("doc_id").collect()
    out = [(r.doc_id, r.text or "", r.label) for r in rows], lambda r: zlib.crc32(str(r[0]).encode()) % folds == part
    return [r for r in out[0] if not out[1](r)], [r for r in out[0] if out[1](r)]


@pytest.fixture(scope="module")
def toxic(spark):
    return _labelled(spark, "toxic", 5, 0)


def _difference(model, pair):
    return abs(sum(model.weights[f] for f in toxicity.word_features(pair[0])) - sum(model.weights[f] for f in toxicity.word_features(pair[1])))


def test_the_penalty_acts_on_the_given_tables(toxic):
    """Few documents name a group, yet the fit with the penalty is another one, and exchanged terms score alike."""
    train, held = toxic
    texts, labels = [r[1] for r in train], np.array([r[2] for r in train])
    plain, fair = (toxicity.fit(texts, labels, strength=s) for s in (0.0, toxicity.COUNTERFACTUAL))
    assert not np.array_equal(plain.weights, fair.weights)
    pairs = toxicity.pairs_of(toxicity.IDENTITY_TERMS)
    before, after = (max(_difference(m, p) for p in pairs) for m in (plain, fair))
    assert after < 0.01 < 0.5 < before
    right = [np.mean([(m.scorer()(t) >= 0.5) == (y == 1) for _, t, y in held]) for m in (plain, fair)]
    assert right[1] >= right[0] - 1e-9 and right[1] > 0.95


def test_exchanging_terms_in_a_sentence_changes_no_score(toxic):
    train, held = toxic
    model = toxicity.fit([r[1] for r in train], np.array([r[2] for r in train]))
    score = model.scorer()
    for _, text, _ in held[:20]:
        for a, b in toxicity.pairs_of(toxicity.IDENTITY_TERMS)[::7]:
            assert abs(score(f"{text} {a}") - score(f"{text} {b}")) < 0.005


def test_slots_take_all_pairs():
    pairs = toxicity.pairs_of(toxicity.IDENTITY_TERMS)
    for texts in (1, 7, 100, 5000):
        taken = {p for i in range(texts) for p in toxicity.slot_swaps(i, texts, pairs)}
        assert taken == set(pairs)
    assert toxicity.slot_swaps(0, 3, []) == []


def test_slopes_are_those_of_the_loss(toxic):
    """Against differences of the loss, which is also written out plainly."""
    rows = toxic[0][:60]
    texts, y = [r[1] for r in rows], np.array([float(r[2]) for r in rows])
    y[:5] = 1.0
    problem = toxicity.Problem(texts, y, toxicity.IDENTITY_TERMS, 3.0)
    draw = np.random.default_rng(4)
    weights, bias = draw.normal(size=toxicity.FEATURES) * 0.3 * (problem.scale > 0), -0.4
    plain = 0.0
    for text, label in zip(texts, y):
        margin = bias + sum(weights[f] * problem.scale[f] for w in toxicity.distinct_words(text) for f in toxicity.word_features(w))
        plain += np.log1p(np.exp(-margin if label else margin)) / len(y)
    swaps = {}
    for number, text in enumerate(texts):
        for pair in [*toxicity.counterfactual_swaps(text, toxicity.IDENTITY_TERMS).elements(), *toxicity.slot_swaps(number, len(texts), toxicity.pairs_of(toxicity.IDENTITY_TERMS))]:
            swaps[pair] = swaps.get(pair, 0) + 1
    value = lambda w: sum(weights[f] * problem.scale[f] for f in toxicity.word_features(w))
    plain += 3.0 * sum(n / len(y) * (value(a) - value(b)) ** 2 for (a, b), n in swaps.items())
    plain += toxicity.RIDGE / 2 * float(weights @ weights)
    assert problem.loss(weights, bias) == pytest.approx(plain, rel=1e-9)
    slope, shift = problem.slopes(weights, bias)
    touched = {int(f) for features, _, _ in problem.differences for f in features}
    for at in [*sorted(touched)[:25], *np.flatnonzero(problem.scale)[:25].tolist()]:
        step = np.zeros(toxicity.FEATURES)
        step[at] = 1e-5
        assert slope[at] == pytest.approx((problem.loss(weights + step, bias) - problem.loss(weights - step, bias)) / 2e-5, abs=1e-6)
    assert shift == pytest.approx((problem.loss(weights, bias + 1e-5) - problem.loss(weights, bias - 1e-5)) / 2e-5, abs=1e-6)


def test_op3_scores_are_plain_sums(spark, toxic):
    model = toxicity.fit([r[1] for r in toxic[0]], np.array([r[2] for r in toxic[0]]))
    got = {r.doc_id: r for r in toxicity.op3_toxicity(spark, SF).collect()}
    for doc_id, text, _ in [*toxic[0][:40], *toxic[1][:40]]:
        total = model.bias + sum(model.weights[f] for w in set(text.lower().split()) for f in toxicity.word_features(w))
        assert got[doc_id].score == pytest.approx(1 / (1 + np.exp(-np.clip(total, -30, 30))), abs=1e-6)
        assert got[doc_id].predicted == int(got[doc_id].score >= 0.5) and got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_op7_scores_are_differences_of_log_densities(spark):
    """Covariances, shrinkage, inverses and determinants by the book, from all labelled rows at once."""
    train, held = _labelled(spark, "quality", 3, 1)
    x, y = np.array([quality.statistics(t) for _, t, _ in train]), np.array([label for _, _, label in train])
    share = np.array([np.mean(y == c) for c in (0, 1)])
    own = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = np.maximum(np.diag(share[0] * own[0] + share[1] * own[1]), 1e-3)
    odds = np.log(((y == 1).sum() + 0.5) / ((y == 0).sum() + 0.5))

    def density(v, c):
        shrunk = (1 - quality.SHRINK) * own[c]
        shrunk[np.diag_indices(len(v))] = (1 - quality.POOL) * np.diag(own[c]) + quality.POOL * pooled
        apart = v - x[y == c].mean(0)
        return -0.5 * apart @ np.linalg.solve(shrunk, apart) - 0.5 * np.linalg.slogdet(shrunk)[1]

    got = {r.doc_id: r for r in quality.op7_quality(spark, SF).collect()}
    for doc_id, text, _ in [*train[::9], *held]:
        v = np.array(quality.statistics(text))
        margin = (density(v, 1) - density(v, 0) + odds) / quality.SOFTEN
        assert got[doc_id].score == pytest.approx(1 / (1 + np.exp(-np.clip(margin, -30, 30))), abs=1e-6)
    assert np.mean([(got[d].predicted == 1) == (label == 1) for d, _, label in held]) > 0.97


def test_shards_do_not_depend_on_the_source(spark):
    """Counts of (source, shard) and of (early or late doc_id, half of the slots) against those of a plain draw, by chi-square."""
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), (F.col("id") % 7).alias("source"))
    path = __import__("tempfile").mkdtemp(prefix="ionloom-shards-")
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    rows = sharding.op2_sharding(spark, path).collect()

    def chi(table):
        expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
        return float(((table - expected) ** 2 / expected).sum()), (table.shape[0] - 1) * (table.shape[1] - 1)

    by_source, by_half = np.zeros((7, 24)), np.zeros((2, 24 * 2))
    for r in rows:
        by_source[r.doc_id % 7, r.shard] += 1
        by_half[int(r.doc_id >= 6000), 2 * r.shard + int(r.slot >= 250)] += 1
    for table in (by_source, by_half):
        value, freedom = chi(table)
        assert abs(value - freedom) < 5 * np.sqrt(2 * freedom)
