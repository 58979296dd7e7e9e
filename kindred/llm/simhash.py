"""Near-duplicates by SimHash fingerprints and vantage-point trees.

Fingerprints: the majority of the bits of XXH64 over word shingles. Links: all
pairs of different fingerprints within a Hamming radius. A vantage-point tree,
fitted on a bounded sample of distinct fingerprints, deals every fingerprint to
one home shard and, as a visitor, to each shard that the triangle inequality
can't exclude; inside a shard a local tree prunes the same way down to exact
comparisons. A shard returns, instead of all pairs, a spanning star for each set
of fingerprints it found linked, so that thousands of near copies give
thousands of rows; a second step joins the stars into components.

Defined results: a text without words, or null, has fingerprint 0 and is linked
like any other; repeated rows share a fingerprint; a null id is ignored when
the smallest id of a component is taken (null if it has no other).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, id_text, materialize, table
from .components import components


@dataclass(frozen=True)
class SimHash:
    shingle: int = 3
    radius: int = 2
    seed: int = 42
    #: Distinct fingerprints that are at home in a shard, about.
    shard: int = 4096
    #: Fingerprints collected to fit the upper tree: 16 for each shard, within these bounds.
    sample: tuple[int, int] = (32_768, 1_048_576)


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if n <= k:
        return hashed(joined, seed)  # one shingle: its own bits are the majority
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    ones, total = np.zeros(64, np.int64), n - k + 1
    for at in range(0, total, 16_384):
        part = zip(starts[at : at + 16_384], ends[at : at + 16_384])
        hashes = np.array([hashed(joined[a:b], seed) for a, b in part], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, cfg: SimHash = SimHash()) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp), fp as a signed 64-bit number; other long columns stay."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), cfg.shingle, cfg.seed) for t in b.column("text")], np.uint64)
            kept = ["doc_id", *others]
            yield pa.record_batch([*map(b.column, kept), pa.array(fps.view(np.int64))], [*kept, "fp"])

    kind = ", ".join(f"{c} long" for c in ("doc_id", *others, "fp"))
    return docs.select(F.col("doc_id").cast("long"), "text", *others).mapInArrow(run, kind)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---------------------------------------------------------------- the tree


def _distance(fps: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ to)


def _choose(fps: np.ndarray, radius: int, tries: int = 12) -> tuple[np.uint64, int] | None:
    """A vantage point of fps, and the distance that splits them with the least overlap."""
    best, n = None, len(fps)
    step = max(1, n // tries)
    for v in fps[::step][:tries]:
        counts = np.bincount(_distance(fps, v), minlength=65 + radius + 1)
        below = np.cumsum(counts)
        for mu in range(64):
            small = min(below[mu], n - below[mu])
            if not small:
                continue
            overlap = below[min(mu + radius, 64)] - below[max(mu - radius, 0)]
            cost = overlap / n + 2.0 * max(0.0, 0.3 - small / n)
            if best is None or cost < best[0]:
                best = (cost, v, mu)
    return best and (best[1], best[2])


class UpperTree:
    """Vantage points down to shards, as arrays: small enough to send to every task."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int):
        self.radius, self.vantage, self.mu, self.child, self.shards = radius, [], [], [], 0
        self._build(sample, depth)
        self.vantage = np.array(self.vantage, np.uint64)
        self.mu, self.child = np.array(self.mu, np.int64), np.array(self.child, np.int64).reshape(-1, 2)

    def _build(self, fps: np.ndarray, depth: int) -> int:
        """The node's number, or -1 - shard."""
        split = _choose(fps, self.radius) if depth and len(fps) > 2 else None
        if split is None:
            self.shards += 1
            return -self.shards
        at = len(self.mu)
        self.vantage.append(split[0]), self.mu.append(split[1]), self.child.append([0, 0])
        inner = _distance(fps, split[0]) <= split[1]
        self.child[at] = [self._build(fps[inner], depth - 1), self._build(fps[~inner], depth - 1)]
        return at

    def deal(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (index into fps, shard, at home): one home each, and where it must also be looked for.

        A pair across a split is found on the inner side: its outer member
        visits there. A visitor goes wherever the triangle inequality allows a
        home member within the radius.
        """
        root = 0 if len(self.mu) else -1
        index = np.arange(len(fps))
        node, home, out = np.full(len(fps), root), np.ones(len(fps), bool), []
        while len(index):
            done = node < 0
            out.append((index[done], -node[done] - 1, home[done]))
            index, node, home = index[~done], node[~done], home[~done]
            d = np.bitwise_count(fps[index] ^ self.vantage[node]).astype(np.int64)
            mu, child = self.mu[node], self.child[node]
            goes_in = np.where(home, d <= mu, d - self.radius <= mu)
            goes_out = np.where(home, d > mu, d + self.radius > mu)
            visits = home & (d > mu) & (d - self.radius <= mu)
            index = np.concatenate([index[goes_in], index[goes_out], index[visits]])
            node = np.concatenate([child[goes_in, 0], child[goes_out, 1], child[visits, 0]])
            home = np.concatenate([home[goes_in], home[goes_out], np.zeros(int(visits.sum()), bool)])
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0, bool)]
        return parts[0], parts[1], parts[2]


class ShardSearch:
    """All links of one shard's home members, kept as merged labels."""

    def __init__(self, fps: np.ndarray, home: np.ndarray, radius: int):
        self.fps, self.radius = fps, radius
        self.label = np.arange(len(fps))
        self._search(np.flatnonzero(home), np.flatnonzero(~home))

    def _merge(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            apart = low != high
            a, b = a[apart], b[apart]
            np.minimum.at(label, high[apart], low[apart])
            while not np.array_equal(up := label[label], label):
                label[:] = up

    def _compare(self, home: np.ndarray, others: np.ndarray) -> None:
        rows = max(1, 250_000 // max(len(others), 1))
        for at in range(0, len(home), rows):
            part = home[at : at + rows]
            near = np.bitwise_count(self.fps[part][:, None] ^ self.fps[others][None, :]) <= self.radius
            i, j = np.nonzero(near)
            self._merge(part[i], others[j])

    def _search(self, home: np.ndarray, visitors: np.ndarray) -> None:
        stack = [(home, visitors)]
        while stack:
            home, visitors = stack.pop()
            if not len(home) or len(home) + len(visitors) < 2:
                continue
            members = np.concatenate([home, visitors])
            if (self.label[members] == self.label[members[0]]).all():
                continue  # linked already: no comparison could add anything
            split = _choose(self.fps[home[:: max(1, len(home) // 512)]], self.radius) if len(home) > 192 else None
            if split is None:
                self._compare(home, members)
                continue
            v, mu = split
            d, e = _distance(self.fps[home], v).astype(np.int64), _distance(self.fps[visitors], v).astype(np.int64)
            ball = home[d <= self.radius // 2]  # so near the vantage point that all are linked
            if len(ball):
                self._merge(np.full(len(ball), ball[0]), ball)
            r, inner = self.radius, d <= mu
            crossing = home[(d > mu) & (d - r <= mu)]
            into = np.concatenate([visitors[e - r <= mu], crossing])
            out = visitors[e + r > mu]
            if inner.all() or not inner.any() or len(into) + len(out) > 1.9 * len(members):
                self._compare(home, members)
                continue
            stack += [(home[inner], into), (home[~inner], out)]


def links(fps: DataFrame, cfg: SimHash = SimHash()) -> DataFrame:
    """Edges (a, b) that connect all different fingerprints (column fp, distinct) within the radius."""
    spark, n = fps.sparkSession, fps.count()
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / cfg.shard))))
    size = min(cfg.sample[1], max(cfg.sample[0], 16 << depth))
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(size).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast(UpperTree(sample, depth, cfg.radius))
    radius = cfg.radius

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mine = b.column("fp").to_numpy().view(np.uint64)
            at, shard, home = tree.value.deal(mine)
            cols = [pa.array(shard.astype(np.int32)), pa.array(mine[at].view(np.int64)), pa.array(home)]
            yield pa.record_batch(cols, ["shard", "fp", "home"])

    def search(shard: pa.Table) -> pa.Table:
        order = np.argsort(shard.column("fp").to_numpy(), kind="stable")
        mine = shard.column("fp").to_numpy()[order].view(np.uint64)
        found = ShardSearch(mine, shard.column("home").to_numpy()[order], radius).label
        linked = np.flatnonzero(found != np.arange(len(found)))
        signed = mine.view(np.int64)
        return pa.table({"a": signed[linked], "b": signed[found[linked]]})

    dealt = fps.select("fp").mapInArrow(deal, "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, cfg: SimHash = SimHash()) -> DataFrame:
    """(doc_id, text) -> doc_id, fp, component_id: the smallest id linked to it, itself included."""
    fps = materialize(fingerprints(docs, cfg), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(distinct, cfg), "simhash")
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("_fp"), "low", F.coalesce("root", "fp").alias("_root")
    )
    lows = rooted.groupBy("_root").agg(F.min("low").alias("component_id")).withColumnRenamed("_root", "_top")
    named = rooted.join(lows, F.col("_root") == F.col("_top")).select("_fp", "component_id")
    return fps.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def text_hashes(text: Column) -> tuple[Column, Column]:
    """128 bits that tell texts apart, as columns h and g."""
    return F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g")


def one_of_each(docs: DataFrame, marks: DataFrame, roots: DataFrame) -> DataFrame:
    """docs with one row of each group: that of the least id (null last), then of the least text hash.

    marks has (doc_id, h, g, fp), a row for each of docs; roots (node, root)
    joins linked fp. Rows are told apart by id and text, never by the id alone.
    """
    rooted = marks.join(roots, F.col("fp") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "fp"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("i"), "h", "g")).alias("m")
    keys = ["_keep_n", "_keep_i", "_keep_h", "_keep_g"]
    keep = rooted.groupBy("_root").agg(least).select(*[F.col("m")[k[-1]].alias(k) for k in keys])
    i, (h, g) = F.col("doc_id").cast("long"), text_hashes(F.col("text").cast("string"))
    # The row travels as one column, so that no name of docs can clash.
    whole = F.struct(*[col(c) for c in docs.columns]).alias("_row")
    keyed = docs.select(whole, i.isNull().alias(keys[0]), F.coalesce(i, F.lit(0)).alias(keys[1]), h.alias(keys[2]), g.alias(keys[3]))
    first = Window.partitionBy(*keys).orderBy(F.col("_row")["text"])
    kept = keyed.join(keep, keys, "left_semi").withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def keep_one(docs: DataFrame, cfg: SimHash = SimHash()) -> DataFrame:
    """docs with one row of each group of near copies, whatever the rows' ids."""
    rows = id_text(docs)
    marks = materialize(fingerprints(rows.select("*", *text_hashes(F.col("text"))), cfg), "marks")
    distinct = materialize(marks.select("fp").distinct(), "distinct")
    return one_of_each(docs, marks, components(links(distinct, cfg), "simhash"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(id_text(table(spark, sf_dir, "documents")))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
