"""Shared helpers: scratch tables, input selection, hashing of word sequences."""

from __future__ import annotations

import gc
import time

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch

#: A word separator, as every contract of this package defines it.
SPACE = r"[\x20\x09-\x0D]"
#: A word.
WORD = r"[^\x20\x09-\x0D]+"

#: Write df as Parquet to the shared folder and read it back: cuts the lineage with files that outlive any executor.
materialize = scratch.written
#: Delete the files of materialized tables.
forget = scratch.forget


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished phases now.

    Spark removes them when the driver's JVM collects its garbage, by default
    every half hour; a phase that has been materialized needs them no longer.
    """
    for _ in range(2):  # objects freed in the first round hold others; the cleaner works in its own thread
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many rows in one Arrow batch: a Python worker holds one batch, and texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names: other columns can't clash."""
    bound_batches(docs.sparkSession)
    return docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))


def rewritten(docs: DataFrame, run) -> DataFrame:
    """docs through run, Arrow batches to Arrow batches of the same schema; only `text` and `n_chars` keep their names in it.

    The function takes columns by name, and names with dots can't be taken so.
    """
    names = docs.columns
    plain = docs.toDF(*[c if c in ("text", "n_chars") else f"_{i}" for i, c in enumerate(names)])
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even inside lambda functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns added, each computed once for a row.

    The optimizer copies a plain column's expression to wherever it is used:
    into each later filter, and into lambda functions, where it would run for
    every element. It doesn't move expressions through a generator.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    out = df.select("*", F.explode_outer(F.array(row)).alias("_computed"))
    return out.select(*[col(c) for c in df.columns], *[F.col("_computed")[n].alias(n) for n in columns])


_BLOCK = 1 << 19
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """An odd 64-bit constant for each number."""
    x = (x.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    return x | np.uint64(1)


def _block_hashes(raw: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    inside = ~_SPACES[raw]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
    starts = at[first]
    place = at - np.repeat(starts, np.diff(np.append(first, len(at))))
    letters = np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)
    values = letters[raw[at]] * mixed(np.arange(int(place.max()) + 1), seed)[place]
    return np.add.reduceat(values, first), starts


def word_hashes(texts: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit multilinear hash of every word of all texts, and the number of its text.

    Bytes are hashed as whole arrays, in blocks that end between words.
    """
    joined = b"\n".join(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    hashes, starts, at = [], [], 0
    while at < len(joined):
        end = min(at + _BLOCK, len(joined))
        while end < len(joined) and not _SPACES[joined[end]]:
            end += 1
        h, s = _block_hashes(np.frombuffer(joined, np.uint8, end - at, at), seed)
        hashes.append(h), starts.append(s + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.searchsorted(ends, np.concatenate(starts), side="right")


def _odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rolling(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A 64-bit multilinear hash of every k consecutive word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(_odd_constants(k, seed)):
        out += hashes[j : j + n] * c
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return out
