"""Repeated passages: de Bruijn compaction of token k-mers.

Every k consecutive words of a document are an edge of a de Bruijn graph. The
graph is never built edge by edge. Consecutive edges with the same minimizer
(the least hash among the shorter word runs inside a k-mer) form a path in
the document, cut at places that depend on the words alone, so copies are cut
alike. The steps:

1. Minimizers that occur in two or more documents; a k-mer without one can't be
   repeated.
2. Paths of such minimizers, with their source coordinates (document, place).
3. A minimizer all of whose paths are the same words is a nonbranching,
   compacted path: its edges share one set of occurrences and one smallest
   source. Where paths differ (a passage begins or ends, or only the minimizer
   recurs) the path branches, and its edges are compared one by one.
4. Joins carry each path's, or edge's, smallest source back to its occurrences;
   consecutive ones that advance along the same source coordinates join into
   long spans, which are cut from the document.

Paths and edges are told apart by their minimizer and, among those of one
minimizer, by a 64-bit hash of their words from another function; words
themselves aren't compared. Counts and minima are pre-aggregated and written;
joins on common passages are joins of two tables, whose large side adaptive
execution splits.

Defined results: null or empty texts have no words; documents shorter than the
window keep all words; rows of one id never cut each other, since neither id
is smaller; a row without an id keeps all and cuts nothing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, id_text, materialize, mixed, release_shuffles, rolling, table, word_hashes


@dataclass(frozen=True)
class Repeats:
    window: int = 13
    #: Words of the runs whose least hash is a window's minimizer.
    run: int = 6
    seeds: tuple[int, int] = (101, 202)


def _split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _windows(texts: list[bytes], cfg: Repeats):
    """Of all texts' windows together: minimizers, edge hashes, text number, place in the text."""
    hashes, text = word_hashes(texts, cfg.seeds[0])
    n, k = len(hashes) - cfg.window + 1, cfg.window
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    runs, inside = rolling(hashes, cfg.run, 1), k - cfg.run + 1
    low, have = runs, 1
    while have < inside:
        step = min(have, inside - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    edges = rolling(word_hashes(texts, cfg.seeds[1])[0], k, 2)
    firsts = np.searchsorted(text, np.arange(len(texts)))
    whole = text[:n] == text[k - 1 :]  # windows across two texts aren't
    where = np.arange(n)[whole]
    mine = text[where]
    return low[where], edges[where], mine, where - firsts[mine]


def _segments(low: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where a new path begins: another minimizer, or another text."""
    return np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (text[1:] != text[:-1])])) if len(low) else low.astype(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _parts(b: pa.RecordBatch, size: int = 500_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with about so many bytes of text each."""
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size or i + 1 == len(texts):
            yield b.slice(at, i + 1 - at), texts[at : i + 1]
            at, total = i + 1, 0


def _sketch(docs: DataFrame, cfg: Repeats) -> DataFrame:
    """(doc, m): the minimizers of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in _parts(b):
                low, _, text, _ = _windows(texts, cfg)
                first = _segments(low, text)
                ids = part.column("doc").to_numpy()[text[first]]
                yield pa.record_batch([pa.array(ids, pa.int64()), _signed(low[first])], ["doc", "m"])

    return docs.mapInArrow(run, "doc long, m long")


def _marked(docs: DataFrame, cfg: Repeats) -> DataFrame:
    """(doc, ms): for each document its minimizers that another document has too."""
    sketch = materialize(_sketch(docs, cfg), "minimizers")
    ends = sketch.groupBy("m").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    # Written first: a join with an aggregate can't be split where one key is hot, one with a table can.
    shared = materialize(ends.where("lo < hi").select(F.col("m").alias("_m")), "shared")
    marks = sketch.join(shared, F.col("m") == F.col("_m")).groupBy("doc").agg(F.collect_set("m").alias("ms"))
    marks = materialize(marks, "marks")
    forget(sketch, shared)
    return marks


def _paths(docs: DataFrame, marks: DataFrame, cfg: Repeats) -> DataFrame:
    """Rows (m, p, doc, copy, at, n, edges): paths with a shared minimizer, and their edges' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in _parts(b):
                low, edges, text, at = _windows(texts, cfg)
                first = _segments(low, text)
                n = np.diff(np.append(first, len(low)))
                place = np.arange(len(low)) - np.repeat(first, n)
                paths = np.add.reduceat(edges * mixed(place, 7), first) if len(first) else edges
                # A minimizer is shared or not in all documents alike: each document's list has those it has.
                keep = np.isin(low[first], part.column("ms").flatten().to_numpy().view(np.uint64))
                inside, first, n = np.repeat(keep, n), first[keep], n[keep]
                copies = np.array([zlib.crc32(t) for t in texts], np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.record_batch(
                    [
                        _signed(low[first]), _signed(paths[keep]),
                        pa.array(part.column("doc").to_numpy()[text[first]], pa.int64()),
                        pa.array(copies[text[first]]), pa.array(at[first].astype(np.int32)),
                        pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(ends, _signed(edges[inside])),
                    ],
                    ["m", "p", "doc", "copy", "at", "n", "edges"],
                )

    marked = docs.join(marks.withColumnRenamed("doc", "_doc"), F.col("doc") == F.col("_doc")).drop("_doc")
    kind = "m long, p long, doc long, copy long, at int, n int, edges array<long>"
    return materialize(marked.mapInArrow(run, kind), "paths")


def _compacted(paths: DataFrame) -> DataFrame:
    """paths whose minimizer two documents have, with src, its smallest (doc, at).

    A path that doesn't branch needs no edges any more: they are null. Of a
    branching path src means nothing.
    """
    graph = paths.groupBy("m").agg(
        F.min(F.struct("doc", "at")).alias("src"), F.max("doc").alias("hi"), F.min("p").alias("a"), F.max("p").alias("z")
    )
    graph = graph.where("src.doc < hi").select(F.col("m").alias("_m"), "src", (F.col("a") == F.col("z")).alias("single"))
    graph = materialize(graph, "graph")
    joined = paths.join(graph, F.col("m") == F.col("_m")).where("not single or doc > src.doc")
    edges = F.when(~F.col("single"), F.col("edges")).alias("edges")
    out = materialize(joined.select("m", "doc", "copy", "at", "n", "src", edges), "compacted")
    forget(graph)
    return out


def _spans(compacted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, copy, at, n, src, src_at): runs of edges that a smaller document has, and where; and a table to delete after use."""
    source = (F.col("src.doc").alias("src"), F.col("src.at").alias("src_at"))
    single = compacted.where("edges is null").select("doc", "copy", "at", "n", *source)
    branching = compacted.where("edges is not null")
    edges = branching.select("m", "doc", "copy", "at", F.posexplode("edges").alias("i", "e"))
    edges = edges.select("m", "e", "doc", "copy", (F.col("at") + F.col("i")).alias("at"))
    # Equal edges have equal minimizers; of one minimizer, edges are told apart by 64 bits.
    firsts = edges.groupBy("m", "e").agg(F.min(F.struct("doc", "at")).alias("src"), F.max("doc").alias("hi"))
    firsts = materialize(firsts.where("src.doc < hi").select(F.col("m").alias("_m"), F.col("e").alias("_e"), "src"), "firsts")
    later = edges.join(firsts, (F.col("m") == F.col("_m")) & (F.col("e") == F.col("_e"))).where("doc > src.doc")
    return single.unionByName(later.select("doc", "copy", "at", F.lit(1).alias("n"), *source)), firsts


def repeated_spans(docs: DataFrame, cfg: Repeats = Repeats()) -> DataFrame:
    """(doc_id, text) -> (doc, copy, spans): by document the runs of windows found in a smaller one.

    copy is the text's CRC-32, which tells rows of one id apart.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc is not null and text is not null")
    marks = _marked(docs, cfg)
    release_shuffles(spark)
    paths = _paths(docs, marks, cfg)
    forget(marks)
    release_shuffles(spark)
    compacted = _compacted(paths)
    forget(paths)
    release_shuffles(spark)
    runs, firsts = _spans(compacted)
    found = runs.groupBy("doc", "copy").agg(F.collect_list(F.struct("at", "n", "src", "src_at")).alias("spans"))
    spans = materialize(found, "spans")
    forget(compacted, firsts)
    release_shuffles(spark)
    return spans


def long_spans(spans: list[dict], k: int) -> list[tuple[int, int]]:
    """Covered word ranges: spans that advance along one source join first, then ranges that touch."""
    runs: list[list[int]] = []
    for s in sorted(spans, key=lambda s: (s["at"], s["n"])):
        last = runs[-1] if runs else None
        if last and s["src"] == last[2] and s["src_at"] - last[3] == s["at"] - last[0] and s["at"] <= last[1]:
            last[1] = max(last[1], s["at"] + s["n"])
        else:
            runs.append([s["at"], s["at"] + s["n"], s["src"], s["src_at"]])
    out: list[tuple[int, int]] = []
    for start, end, *_ in runs:
        end += k - 1
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without_repeats(docs: DataFrame, cfg: Repeats = Repeats()) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, kept (the words left, one space between)."""
    spans = repeated_spans(docs, cfg)
    k = cfg.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part, out = b.slice(at, 512), []
                for text, cut in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    words = _split(text)
                    n = len(words)
                    for a, z in reversed(long_spans(cut, k) if cut else []):
                        del words[a:z]
                    kept = b" ".join(words)
                    out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
                cols = [pa.array(c) for c in zip(*out)]
                yield pa.record_batch(
                    [part.column("doc_id"), cols[0].cast(pa.int64()), cols[1].cast(pa.int64()), cols[2], cols[3]],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    mine = docs.select(F.col("doc_id").cast("long"), "text", F.crc32(F.col("text").cast("binary")).alias("_copy"))
    joined = mine.join(spans, (F.col("doc_id") == F.col("doc")) & (F.col("_copy") == F.col("copy")), "left")
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return joined.select("doc_id", "text", "spans").mapInArrow(run, kind)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(id_text(table(spark, sf_dir, "documents"))).drop("kept")
