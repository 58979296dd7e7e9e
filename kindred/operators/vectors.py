"""Character n-grams, TF-IDF weights in long form, and dense encoders made from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import tokens


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """All n-grams inside each word, the word having a space on either side; an array with repeats."""

    def of_word(w: Column) -> Column:
        padded, size = F.concat(F.lit(" "), w, F.lit(" ")), F.length(w) + 2
        sizes = F.sequence(F.lit(low), F.least(F.lit(high), size))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substr(padded, i, n))))

    return F.flatten(F.transform(tokens(text), of_word))


def _counts(texts: DataFrame, group: str, low: int, high: int, *more: str) -> DataFrame:
    counts = texts.select("id", group, *more, F.explode(char_ngrams(F.col("text"), low, high)).alias("gram"))
    return counts.groupBy("id", group, *more, "gram").agg(F.count(F.lit(1)).alias("tf"))


def idf(texts: DataFrame, group: str = "grp", min_df: int = 2, low: int = 2, high: int = 4) -> DataFrame:
    """(id, grp, text) -> (grp, gram, idf), of grams that at least min_df of the group's texts have.

    A row may stand for several: `copies` ids with this text, from `n_rows` rows.
    """
    many = "copies" in texts.columns
    sizes = texts.groupBy(group).agg((F.sum("n_rows") if many else F.count(F.lit(1))).alias("n"))
    counts = _counts(texts, group, low, high, *["copies"] * many).groupBy(group, "gram")
    df = counts.agg((F.sum("copies") if many else F.count(F.lit(1))).alias("df")).where(F.col("df") >= min_df)
    return df.join(sizes, group).select(group, "gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(
    texts: DataFrame, group: str = "grp", min_df: int = 2, low: int = 2, high: int = 4, fitted: DataFrame | None = None
) -> DataFrame:
    """(id, grp, text) -> (id, grp, gram, w): weights of unit length for each text.

    Sublinear counts, smoothed inverse document frequencies within the group,
    grams in fewer than min_df of the group's texts left out. The frequencies
    are those of these texts, or `fitted`, as `idf` gives them.
    """
    counts = _counts(texts, group, low, high)
    known = idf(texts, group, min_df, low, high) if fitted is None else fitted
    raw = counts.join(known, [group, "gram"]).select("id", group, "gram", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
    norms = raw.groupBy("id", group).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, ["id", group]).select("id", group, "gram", (F.col("raw") / F.col("norm")).alias("w"))


def unit(v: Column) -> Column:
    """An array scaled to length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(norm == 0, x).otherwise(x / norm))


def random_projection(weights: DataFrame, dim: int = 256, seed: int = 0, remembered: int = 100_000) -> DataFrame:
    """(id, grp, gram, w) -> (id, grp, vector): a Gaussian projection that needs no vocabulary.

    Each gram's row of the projection is drawn from its own hash, so that any
    worker makes the same one; a worker remembers so many rows. The weights are
    dealt out once, by id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known: dict[str, np.ndarray] = {}

        def row(gram: str) -> np.ndarray:
            if (got := known.get(gram)) is None:
                if len(known) >= remembered:
                    known.clear()
                got = known[gram] = np.random.default_rng(xxhash.xxh64_intdigest(gram, seed)).standard_normal(dim) / np.sqrt(dim)
            return got

        for b in batches:
            out = []
            for grams in b.column("grams").to_pylist():
                v = sum(x["w"] * row(x["gram"]) for x in sorted(grams, key=lambda x: x["gram"]))
                norm = np.linalg.norm(v)
                out.append((v / norm if norm else v).astype(np.float32))
            yield pa.record_batch([b.column("id"), b.column("grp"), pa.array(out, pa.list_(pa.float32()))], ["id", "grp", "vector"])

    by_id = weights.groupBy("id", "grp").agg(F.collect_list(F.struct("gram", "w")).alias("grams"))
    kinds = dict(weights.dtypes)
    return by_id.mapInArrow(run, f"id {kinds['id']}, grp {kinds['grp']}, vector array<float>")


def truncated_svd(weights: DataFrame, dim: int = 64, buckets: int = 2048) -> DataFrame:
    """(id, grp, gram, w) -> (id, grp, vector): singular vectors of the weights, grams hashed to buckets.

    The Gram matrix of the buckets, whose size doesn't depend on the data, is
    summed by the executors; its eigenvectors are found on the driver.
    """
    hashed = weights.groupBy("id", "grp", F.pmod(F.xxhash64("gram"), F.lit(buckets)).alias("b")).agg(F.sum("w").alias("w"))
    pairs = hashed.alias("x").join(hashed.alias("y"), ["id", "grp"])
    gram = pairs.groupBy(F.col("x.b").alias("i"), F.col("y.b").alias("j")).agg(F.sum(F.col("x.w") * F.col("y.w")).alias("s"))
    cells = gram.toPandas()  # buckets x buckets at most
    used = np.unique(cells["i"])
    full = np.zeros((len(used), len(used)))
    full[np.searchsorted(used, cells["i"]), np.searchsorted(used, cells["j"])] = cells["s"]
    values, vectors = np.linalg.eigh(full)
    keep = np.argsort(-values)[: min(dim, len(values))]
    rows = [(int(b), [float(x) for x in r]) for b, r in zip(used, vectors[:, keep])]
    # One row for each bucket: its size is fixed by the parameter.
    basis = F.broadcast(weights.sparkSession.createDataFrame(rows, "b long, r array<double>"))
    parts = hashed.join(basis, "b").select("id", "grp", F.posexplode(F.transform("r", lambda x: x * F.col("w"))).alias("i", "x"))
    sums = parts.groupBy("id", "grp", "i").agg(F.sum("x").alias("x")).groupBy("id", "grp").agg(
        F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")
    )
    return sums.select("id", "grp", unit(F.transform("v", lambda s: s["x"])).alias("vector"))


def encoder(kind: str):
    """The encoder of a name: "rp", "svd", or "st:<model>", for which a model must be plugged in."""
    known = {"rp": random_projection, "svd": truncated_svd}
    if kind in known:
        return known[kind]
    if kind.startswith("st:") and kind in PLUGGED:
        return PLUGGED[kind]
    raise ValueError(f"unknown encoder {kind!r}; known: {', '.join([*known, *PLUGGED])}")


#: Sentence encoders that callers add: name -> function of (id, grp, text) giving (id, grp, vector).
PLUGGED: dict = {}
