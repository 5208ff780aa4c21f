"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of the words' beginnings, of neighbouring word pairs
and of pairs with one word between (skip-grams), and of whether it holds a word in capitals. Each
coordinate has a learning rate of its own, and the L1 term keeps most weights at exactly zero, so the model is a
short list of (place, weight), at most ``2 ** BITS`` long, that fits any broadcast.

Labels are learned from a bounded sample: of the labelled rows that may be used, the ``sample_rows`` with the
smallest hash of their id. Features of the sample are made in parallel; one task then runs the updates
in hash order, which makes the model the same however the input is partitioned. Scoring is one pass over the
documents without a shuffle.

Defined results: a null text counts as empty; an empty text gets the score of the bias alone; without any label
of each class the score is the share of toxic labels (0 if there are none); rows with a null id are scored
and not held out; labels that are null or have no document are not used; repeated rows give a row each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.shared import SLICE, map_slices, written

BITS = 20
TOKENS = re.compile(r"\w+|[^\w\s]+")
STEM = 5
#: Words that a worker remembers the hashes of; when full they are forgotten.
REMEMBERED = 150_000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Fixed odd multipliers and offsets that tell the kinds of features apart.
WORD, BEGINNING, PAIR, SKIP = (np.uint64(x) for x in (1, 3 << 40, 7 << 40, 11 << 40))
CAPITALS = 0


class Features:
    """Hashes texts; remembers words."""

    def __init__(self) -> None:
        self.places: dict[str, int] = {}
        self.words = np.zeros(1024, np.uint64)
        self.stems = np.zeros(1024, np.uint64)
        self.upper = np.zeros(1024, bool)

    def _learn(self, word: str) -> int:
        place = self.places[word] = len(self.places)
        if place == len(self.words):
            self.words, self.stems, self.upper = (np.concatenate([x, np.zeros_like(x)]) for x in (self.words, self.stems, self.upper))
        low = word.lower()
        self.words[place] = crc32(low.encode())
        self.stems[place] = crc32(low[:STEM].encode())
        self.upper[place] = len(word) > 1 and word.isupper()
        return place

    def __call__(self, text: str) -> np.ndarray:
        """Places of all features, with repeats."""
        found = TOKENS.findall(text)
        if not found:
            return np.zeros(0, np.int64)
        if len(self.places) > REMEMBERED:
            self.places.clear()
        known, learn = self.places.get, self._learn
        at = np.array([p if (p := known(w)) is not None else learn(w) for w in found])
        w = self.words[at]
        kinds = [w + WORD, self.stems[at] + BEGINNING, w[:-1] * np.uint64(31) + w[1:] + PAIR, w[:-2] * np.uint64(37) + w[2:] + SKIP]
        places = ((np.concatenate(kinds) * MIX) >> np.uint64(64 - BITS)).astype(np.int64)
        return np.append(places, CAPITALS) if self.upper[at].any() else places


@dataclass(frozen=True)
class Ftrl:
    """FTRL-proximal: learning rate alpha / (beta + root of summed squares), L1 and L2 terms; positives weigh more."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.0
    positive: float = 3.0
    updates: int = 48_000
    least_epochs: int = 4
    most_epochs: int = 12

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def fit(self, examples: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights that are not zero; the bias has the place 2 ** BITS."""
        if not labels:
            return np.zeros(0, np.int64), np.zeros(0)
        share = sum(labels) / len(labels)
        bias = 1 << BITS
        if share in (0.0, 1.0):
            return np.array([bias]), np.array([np.inf if share else -np.inf])
        z, n = np.zeros(bias + 1), np.zeros(bias + 1)
        epochs = min(self.most_epochs, max(self.least_epochs, self.updates // len(labels)))
        for _ in range(epochs):
            for x, y in zip(examples, labels):
                zi, ni = z[x], n[x]
                w = self.weights(zi, ni)
                p = 1 / (1 + np.exp(-min(35.0, max(-35.0, w.sum()))))
                g = (p - y) * (self.positive if y else 1.0)
                z[x] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / self.alpha * w
                n[x] = ni + g * g
        w = self.weights(z, n)
        places = np.flatnonzero(w)
        return places, w[places]


def train(docs: DataFrame, labels: DataFrame, model: Ftrl, sample_rows: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(place long, weight double), written to the shared folder. Rows held out must be gone from ``labels``."""
    order = F.xxhash64(F.col("id").cast("string"))
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    chosen = chosen.groupBy("id").agg(F.max("y").alias("y")).withColumn("o", order).orderBy("o", "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            x = [np.append(np.unique(features(t or "")), 1 << BITS).astype(np.int32).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"o": batch["o"], "y": batch["y"], "x": x})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        examples, labels = [], []
        for batch in batches:
            examples += [np.frombuffer(x, np.int32) for x in batch["x"]]
            labels += [int(y > 0) for y in batch["y"]]
        places, weights = model.fit(examples, labels)
        yield pd.DataFrame({"place": places, "weight": weights})

    rows = map_slices(texts.select("o", "y", "text"), featured, "o long, y int, x binary")
    return written(rows.repartition(1).sortWithinPartitions("o", "x").mapInPandas(fitted, "place long, weight double"), "weights")


class Scorer:
    def __init__(self, places: np.ndarray, weights: np.ndarray):
        self.features, self.table = Features(), np.zeros((1 << BITS) + 1)
        self.table[places] = weights
        self.live = self.table != 0
        self.bias = self.table[1 << BITS] if len(places) else -np.inf

    def __call__(self, text: str | None) -> float:
        if np.isinf(self.bias):
            return float(self.bias > 0)
        found = self.features(text or "")
        total = self.table[np.unique(found[self.live[found]])].sum() + self.bias
        return float(1 / (1 + np.exp(-min(700.0, max(-700.0, total)))))


def scores(weights: DataFrame):
    """A column function from text to score; the weights, of which there are 2 ** BITS + 1 at most, are broadcast."""
    rows = weights.collect()
    places, values = np.array([r["place"] for r in rows], np.int64), np.array([r["weight"] for r in rows])
    shared = weights.sparkSession.sparkContext.broadcast((places, values))

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(*shared.value)
        for batch in texts:
            slices = (batch.slice(at, SLICE).to_pylist() for at in range(0, len(batch), SLICE))
            yield pa.array([scorer(t) for part in slices for t in part], pa.float64())

    return scored


#: Share of ids that are kept from training: remainder 1 of three.
def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = 12_000, model: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, held_out, score, predicted (1 from the threshold on)."""
    weights = train(docs, labels.filter(~held_out(id_col)), model, sample_rows, id_col, text_col)
    scored = docs.select(id_col, scores(weights)(F.col(text_col)).alias("score"))
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = 12_000, model: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents below the threshold, with all their columns."""
    weights = train(docs, labels.filter(~held_out(id_col)), model, sample_rows, id_col, text_col)
    return docs.filter(scores(weights)(F.col(text_col)) < threshold)
