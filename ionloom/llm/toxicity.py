"""Toxicity scores from a counterfactually regularised linear classifier over words.

A document's score is the logistic of a sum over its distinct words. The value of a word is the sum of the
weights of its features, the word itself and its beginnings, hashed into a table of bounded size. Features
count in proportion to how clearly they go with the label, and not at all when they do not.

Counterfactuals: in every labelled sentence that names a group, the identity term is exchanged for each other
term of its list and for a neutral word of the language. Corpora name few groups, so every labelled text also takes SLOTS such
pairs at one of its words, in turn through all pairs: once one term stands there, once the other. The change that an
exchange makes to the score is penalised with its square, so that the classifier learns nothing from which group is named, or that one
is, not even by way of other words that begin like a term.

It is fitted on MAX_TRAIN labelled documents at most (those with the smallest hash of doc_id), in one task;
every text is scored whole. Null and empty texts have the score of a text without known words. Labels that
are neither 0 nor 1 and labels without a document are not used; without labels of both kinds every score is
the share of label 1, or a half without any. Repeated rows score alike. An empty table gives no rows; columns
other than doc_id and text are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm.common import documents
from ionloom.llm.labelled import held_out, training_labels

#: Labelled documents that are used for fitting.
MAX_TRAIN = 10_000
FEATURES = 2**18
BEGINNINGS = (3, 4, 5, 6, 7)
ROUNDS = 100
RIDGE = 1e-5
#: Features whose association with the label has a z value below this do not count.
LEAST_Z = 2.0
COUNTERFACTUAL = 10.0
CACHED_WORDS = 300_000
#: Pairs of terms that every labelled text takes at a word.
SLOTS = 8

# Identity terms that are exchanged for each other, list by list, the last of each list neutral, in four languages.
IDENTITY_TERMS = [
    ["christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist", "person"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists", "persons"],
    ["black", "white", "asian", "latino", "hispanic", "arab", "indigenous", "african", "european", "person"],
    ["gay", "lesbian", "bisexual", "transgender", "queer", "straight", "heterosexual", "homosexual", "person"],
    ["man", "woman", "person"], ["men", "women", "people"], ["boy", "girl", "child"], ["male", "female", "person"],
    ["old", "young", "elderly", "teenage", "person"], ["disabled", "blind", "deaf", "paralyzed", "person"],
    ["immigrant", "refugee", "foreigner", "migrant", "person"], ["immigrants", "refugees", "foreigners", "migrants", "people"],
    ["christ", "muslim", "jude", "hindu", "katholik", "atheist", "mensch"], ["schwarze", "weiße", "asiate", "araber", "mensch"],
    ["schwul", "lesbisch", "homosexuell", "mensch"], ["mann", "frau", "mensch"], ["ausländer", "flüchtling", "einwanderer", "mensch"],
    ["cristiano", "musulmán", "judío", "católico", "ateo", "persona"], ["negro", "blanco", "asiático", "árabe", "persona"],
    ["gay", "lesbiana", "homosexual", "persona"], ["hombre", "mujer", "persona"], ["inmigrante", "refugiado", "extranjero", "persona"],
    ["chrétien", "musulman", "juif", "catholique", "athée", "personne"], ["noir", "blanc", "asiatique", "arabe", "personne"],
    ["gay", "lesbienne", "homosexuel", "personne"], ["homme", "femme", "personne"], ["immigré", "réfugié", "étranger", "personne"],
]

_MARKS = ".,;:!?*$%&#|\"'()[]«»¿¡…"
_SENTENCE = re.compile(r"[.!?\n]+")


def word_features(word: str) -> list[int]:
    bare = word.strip(_MARKS)
    parts = ["w" + bare] + ["p" + bare[:k] for k in BEGINNINGS if len(bare) > k]
    return [xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass")) % FEATURES for p in parts]


def distinct_words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def pairs_of(terms: list[list[str]]) -> list[tuple[str, str]]:
    """Every two terms of a list, each pair once."""
    return list(dict.fromkeys(pair for group in terms for pair in combinations(group, 2)))


def counterfactual_swaps(text: str, terms: list[list[str]]) -> Counter:
    """How often each (term, other term) exchange is possible in the sentences of a text that name a group."""
    known: dict[str, set[str]] = {}
    for group in terms:
        for term in group[:-1]:
            known.setdefault(term, set()).update(group)
    found: Counter = Counter()
    lower = text.lower()
    if not any(t in lower for t in known):
        return found
    for sentence in _SENTENCE.split(lower):
        for word in {w.strip(_MARKS) for w in sentence.split()} & known.keys():
            found.update((word, other) for other in known[word] if other != word)
    return found


def slot_swaps(number: int, texts: int, pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The pairs that the text of this number takes; together the texts take all."""
    each = max(SLOTS, -(-len(pairs) // texts)) if pairs else 0
    return [pairs[(number * each + k) % len(pairs)] for k in range(each)]


@dataclass
class Toxicity:
    """The bias and the weight of each hashed feature."""

    bias: float
    weights: np.ndarray

    def scorer(self):
        """A function from texts to scores that remembers the values of words."""
        values: dict[str, float] = {}
        weights = self.weights

        def of(text: str | None) -> float:
            total = self.bias
            for word in distinct_words(text):
                value = values.get(word)
                if value is None:
                    if len(values) >= CACHED_WORDS:
                        values.clear()
                    value = values[word] = float(weights[word_features(word)].sum())
                total += value
            return 1 / (1 + float(np.exp(-np.clip(total, -30, 30))))

        return of


class Problem:
    """What is minimised: mean logistic loss, a small ridge, and the squared score changes of exchanged terms."""

    def __init__(self, texts: list[str], labels: np.ndarray, terms: list[list[str]], strength: float):
        self.y, self.strength = np.asarray(labels, float), strength
        y, cache = self.y, {}
        rows, swaps, pairs = [], Counter(), pairs_of(terms)
        for number, text in enumerate(texts):
            own: list[int] = []
            for word in sorted(distinct_words(text)):
                if word not in cache:
                    cache[word] = word_features(word)
                own += cache[word]
            rows.append(np.array(own, np.int32))
            swaps.update(counterfactual_swaps(text or "", terms))
            if own:
                swaps.update(slot_swaps(number, len(texts), pairs))
        at = np.concatenate(rows)
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        ones, n1, n0 = y[row], y.sum(), len(y) - y.sum()
        with1, with0 = np.bincount(at, ones, FEATURES), np.bincount(at, 1 - ones, FEATURES)
        z = (with1 / n1 - with0 / n0) / np.sqrt((with1 + with0 + 1) * (1 / n1 + 1 / n0) / len(y))
        scale = np.maximum(0, np.abs(z) - LEAST_Z)
        self.scale = scale / max(scale.max(), 1e-9)
        keep = self.scale[at] > 0
        self.at, self.row = at[keep], row[keep]
        self.differences = []
        for (term, other), times in swaps.items():
            own = Counter(word_features(term))
            own.subtract(word_features(other))
            features = np.array([f for f, n in own.items() if n and self.scale[f] > 0], np.int64)
            if len(features):
                self.differences.append((features, np.array([own[f] for f in features.tolist()]) * self.scale[features], times / len(y)))

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.row, (weights * self.scale)[self.at], len(self.y))

    def loss(self, weights: np.ndarray, bias: float) -> float:
        margin = self.margins(weights, bias)
        fair = sum(share * (weights[features] @ change) ** 2 for features, change, share in self.differences)
        return float(np.mean(np.logaddexp(0, margin) - self.y * margin) + RIDGE / 2 * weights @ weights + self.strength * fair)

    def slopes(self, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        """How the loss changes with the weights and the bias."""
        error = (1 / (1 + np.exp(-np.clip(self.margins(weights, bias), -30, 30))) - self.y) / len(self.y)
        slope = np.bincount(self.at, error[self.row], FEATURES) * self.scale + RIDGE * weights
        for features, change, share in self.differences:
            slope[features] += 2 * self.strength * share * (weights[features] @ change) * change
        return slope, float(error.sum())


def fit(texts: list[str], labels: np.ndarray, terms: list[list[str]] = IDENTITY_TERMS, strength: float = COUNTERFACTUAL) -> Toxicity:
    """Full-batch fit with adaptive steps; `strength` weighs the counterfactual penalty."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        return Toxicity(float(np.log(share / (1 - share))), np.zeros(FEATURES))
    problem = Problem(texts, y, terms, strength)
    weights, bias = np.zeros(FEATURES), float(np.log(y.sum() / (len(y) - y.sum())))
    mean, square = np.zeros(FEATURES), np.zeros(FEATURES)
    for step in range(1, ROUNDS + 1):
        slope, shift = problem.slopes(weights, bias)
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        weights -= 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        bias -= 2 * shift
    return Toxicity(float(bias), weights * problem.scale)


def fit_on(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, terms: list[list[str]] = IDENTITY_TERMS, strength: float = COUNTERFACTUAL) -> Toxicity:
    """The classifier fitted on at most `max_train` of the documents with a label."""
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sorted(((i, t or "", y) for b in batches for t, y, i in zip(*(c.to_pylist() for c in b.columns))))
        made = fit([t for _, t, _ in seen], np.array([y for _, _, y in seen]), terms, strength)
        yield pa.RecordBatch.from_arrays([pa.array([made.bias]), pa.array([made.weights.tobytes()])], ["bias", "weights"])

    found = rows.repartition(1).mapInArrow(run, "bias double, weights binary").collect()
    return Toxicity(found[0]["bias"], np.frombuffer(found[0]["weights"])) if found else fit([], np.array([]))


def scored(docs: DataFrame, model: Toxicity) -> DataFrame:
    """`docs` (doc_id, text, held_out) as (doc_id, held_out, score, predicted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            values = np.array([score(t.as_py()) for t in batch.column(2)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values), pa.array((values >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), "held_out", "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_on(docs, training_labels(spark, sf_dir, "toxic", 5, 0))
    return scored(docs.withColumn("held_out", held_out(5, 0)), model)
