"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the different character n-grams inside a text's words, hashed.
Each is scaled by the log ratio of its smoothed document frequencies in toxic
and other training texts, and a logistic regression is trained on the scaled
features. Training takes a bounded sample of labelled rows, the number of each
class being a parameter; scoring takes every text whole.

Labels of rows whose crc32(doc_id as text) mod 5 is 0 are never learnt from.

Defined results: null or empty texts score like a text without features (the
intercept); a null label isn't learnt from, several label rows of one id count
as several; repeated document rows are scored alike; a text of any length is
scored whole; with no label of one of the classes all texts score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, id_text, table

#: Bytes of words; all others separate them.
_KEPT = np.array([c if chr(c).isalnum() and c < 128 or c == 39 or c > 127 else 32 for c in range(256)], np.uint8)


@dataclass(frozen=True)
class Toxicity:
    grams: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    #: Labelled rows of each class that are learnt from, at most: those of least hash.
    rows_per_class: int = 4000
    #: Bytes of their texts, at most: a text that would go beyond isn't learnt from, nor are those after it.
    bytes_per_class: int = 32_000_000
    #: Standard errors that a log-count ratio must have to count.
    errors: float = 2.0
    epochs: int = 20
    rate: float = 0.5
    decay: float = 1e-5
    seed: int = 5


class Grams:
    """The hashed n-grams of a text's words, a space on either side of each word counting as its part.

    The whole text is hashed as one array of bytes; an n-gram with a space
    inside spans two words and doesn't count.
    """

    def __init__(self, cfg: Toxicity):
        rng = np.random.default_rng(cfg.seed)
        self.letters = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.places = {n: rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in cfg.grams}
        self.shift = np.uint64(64 - cfg.bits)

    def all(self, text: str | None) -> Iterator[np.ndarray]:
        """For each n, the hashes of all n-grams, repeats included."""
        raw = _KEPT[np.frombuffer(f" {(text or '').lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
        values = self.letters[raw]
        spaces = np.concatenate([[0], np.cumsum(raw == 32)])
        for n, places in self.places.items():
            size = len(raw) - n + 1
            if size > 0:
                whole = np.flatnonzero(spaces[n - 1 : n - 1 + size] == spaces[1 : 1 + size])
                hashes = np.zeros(size, np.uint64)
                for j, c in enumerate(places):
                    hashes += values[j : j + size] * c
                yield (hashes[whole] >> self.shift).astype(np.int32)

    def __call__(self, text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
        """The different hashes; with `wanted`, a mask over all hashes, only those in it."""
        parts = [h if wanted is None else h[wanted[h]] for h in self.all(text)]
        return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int32)


class Classifier:
    """weight (by hashed n-gram, its naive Bayes scale included) and intercept."""

    def __init__(self, texts: list[str], toxic: list[int], cfg: Toxicity):
        self.cfg, self.weight, self.intercept = cfg, np.zeros(1 << cfg.bits, np.float32), -50.0
        grams, y = Grams(cfg), np.array(toxic, np.float64)
        if not (0 < y.sum() < len(y)):
            return
        rows = [grams(t) for t in texts]
        counts = [np.ones(1 << cfg.bits), np.ones(1 << cfg.bits)]
        for r, label in zip(rows, toxic):
            counts[int(label)][r] += 1
        scale = np.log((counts[1] / (y.sum() + 2)) / (counts[0] / (len(y) - y.sum() + 2)))
        # Shrunk by `errors` times its standard error: a ratio that chance could make is 0.
        scale = np.sign(scale) * np.maximum(0, np.abs(scale) - cfg.errors * np.sqrt(1 / counts[0] + 1 / counts[1]))
        # Features of scale 0 can't move the score.
        rows = [r[scale[r] != 0] for r in rows]
        self._fit(rows, y, scale, np.random.default_rng(cfg.seed))

    def _fit(self, rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, rng: np.random.Generator) -> None:
        """Logistic regression by AdaGrad, both classes weighing the same."""
        w, squares, b, b2 = np.zeros(len(scale)), np.full(len(scale), 1e-2), 0.0, 1e-2
        share = y.mean()
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        for _ in range(self.cfg.epochs):
            for i in rng.permutation(len(y)):
                r = rows[i]
                s = scale[r]
                z = float(w[r] @ s) + b
                g = weight[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i])
                if abs(g) < 1e-3:
                    continue
                step = g * s + self.cfg.decay * w[r]
                squares[r] += step * step
                w[r] -= self.cfg.rate * step / np.sqrt(squares[r])
                b2 += g * g
                b -= self.cfg.rate * g / np.sqrt(b2)
        self.weight, self.intercept = (w * scale).astype(np.float32), float(b)

    def score(self, grams: np.ndarray) -> float:
        z = float(self.weight[grams].sum(dtype=np.float64)) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, cfg: Toxicity = Toxicity()) -> Classifier:
    """docs (doc_id, text), labels (doc_id, toxic): fitted on the driver from the bounded sample."""
    known = labels.select(col("doc_id").cast("long").alias("doc_id"), col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.xxhash64(F.lit(cfg.seed), "doc_id")
    parts = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(cfg.rows_per_class) for k in (0, 1)]
    # Not more than two classes of rows: a size that doesn't grow with the corpus.
    chosen = F.broadcast(parts[0].union(parts[1]))
    rows = docs.where("text is not null").join(chosen, "doc_id").select("doc_id", "toxic", "text", order.alias("o"), F.xxhash64("text").alias("h"))
    # One id may have many rows: the bound holds for these too, and for their bytes.
    parts = [rows.where(F.col("toxic") == k).orderBy("o", "doc_id", "h").limit(cfg.rows_per_class) for k in (0, 1)]
    sofar = Window.partitionBy("toxic").orderBy("o", "doc_id", "h").rowsBetween(Window.unboundedPreceding, 0)
    rows = parts[0].union(parts[1]).withColumn("bytes", F.sum(F.octet_length("text")).over(sofar)).where(F.col("bytes") <= cfg.bytes_per_class)
    rows = rows.select("doc_id", "toxic", "text").toPandas().sort_values(["doc_id", "toxic", "text"])
    return Classifier(rows["text"].tolist(), rows["toxic"].tolist(), cfg)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        grams, wanted = Grams(model.cfg), model.weight != 0
        for b in batches:
            scores = [model.score(grams(t.as_py(), wanted)) for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_text(table(spark, sf_dir, "documents"))
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
