"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all normalised benchmark items, one for each block of items, is
streamed over every document's words: it keeps the length of the
longest suffix of the words read so far that occurs in an item. Where that
length reaches the window, the last words are an occurrence; the automaton's
state tells which items have it.

Defined results: null texts have no words; an item without words matches
nothing; an item with fewer words than the window is one window by itself;
items of one id count once, items without an id are matched but written as an
empty string; an empty benchmark leaves every document clean; repeated documents
are judged alike; a text of any length is scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, col, id_text, rewritten, table

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class Decontamination:
    window: int = 10
    #: Characters of items in one automaton; more items make more blocks, each run over all documents.
    block_chars: int = 2_000_000
    #: Bytes of text that go through one block after the other; what building an automaton costs is shared by them.
    chunk_bytes: int = 32_000_000
    #: A document that loses at least this share of its words is dropped whole by `decontaminate`.
    max_coverage: float = 0.5


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_LOWER)) if text else []


class SuffixAutomaton:
    """All substrings of some word sequences; an item's words never join with the next item's."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.window = window
        self.step: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: Of a state that has a window: the items it occurs in. Windows are told apart by (state, length).
        self.found: dict[int, dict[int, set[str]]] = {}
        for name, words in items:
            self._register(name, words)
        self._known: dict[int, tuple] = {}
        self.least = min((n for by in self.found.values() for n in by), default=0)

    def _new(self, step: dict[str, int], link: int, length: int) -> int:
        self.step.append(step), self.link.append(link), self.length.append(length)
        return len(self.step) - 1

    def _split(self, p: int, w: str, q: int) -> int:
        """A copy of q for the shorter suffixes that end in p and w."""
        copy = self._new(dict(self.step[q]), self.link[q], self.length[p] + 1)
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, w: str) -> int:
        if (q := self.step[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._new({}, 0, self.length[last] + 1), last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _home(self, state: int, n: int) -> int:
        """The state that has the suffix of length n."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _register(self, name: str, words: list[str]) -> None:
        n, state = min(self.window, len(words)), 0
        if not n:
            return
        for i, w in enumerate(words):
            state = self.step[state][w]
            if i + 1 >= n:
                self.found.setdefault(self._home(state, n), {}).setdefault(n, set()).add(name)

    def _chain(self, state: int) -> tuple:
        """(n, items) of all windows that are suffixes of the state's longest, longest first."""
        path = []
        while state and state not in self._known:
            path.append(state)
            state = self.link[state]
        got = self._known.get(state, ())
        for s in reversed(path):
            own = tuple(sorted(self.found.get(s, {}).items(), reverse=True))
            got = self._known[s] = own + got
        return got

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """The covered spans of words, merged, and the items that occur."""
        step, link, length, least = self.step, self.link, self.length, self.least
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if not least:
            return spans, items
        state = n = 0
        for i, w in enumerate(words):
            to = step[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = step[state].get(w)
            if to is None:
                continue
            state, n = to, n + 1
            if n < least:
                continue
            longest = 0
            for size, names in self._chain(state):
                if size <= n:
                    items |= names
                    longest = longest or size
            if longest:
                start = i + 1 - longest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, items


def _blocks(items: DataFrame, cfg: Decontamination) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks of bounded size; the driver holds one at a time."""
    block, room = [], cfg.block_chars
    for row in items.toLocalIterator():
        if block and room < len(row.text):
            yield block
            block, room = [], cfg.block_chars
        room -= len(row.text)
        block.append((row.item_id or "", row.text))
    if block:
        yield block


class Scanner:
    """The automata of all blocks. A worker holds one at a time, and goes through a chunk of texts with each."""

    def __init__(self, spark: SparkSession, benchmark: DataFrame, cfg: Decontamination):
        items = benchmark.select(col("item_id").cast("string").alias("item_id"), col("text").alias("text"))
        items = items.where("text is not null")
        self.blocks = [spark.sparkContext.broadcast(b) for b in _blocks(items, cfg)]
        self.window = cfg.window
        self.held: tuple[int, SuffixAutomaton] | None = None

    def _automaton(self, n: int) -> SuffixAutomaton:
        if self.held is None or self.held[0] != n:
            self.held, block = None, self.blocks[n]
            # Read without keeping it: a worker must not gather the whole benchmark.
            items = block.load_from_path(block._path) if block._path else block.value
            self.held = n, SuffixAutomaton([(i, words_of(t)) for i, t in items], self.window)
        return self.held[1]

    def __call__(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text its number of words, covered spans of words, and the items that occur."""
        out: list[tuple[int, list, set]] = [(0, [], set()) for _ in texts]
        held = [self.held[0]] if self.held else []
        # The block in hand first, so that with few blocks hardly any is built twice.
        for n in held + [n for n in range(len(self.blocks)) if n not in held]:
            automaton = self._automaton(n)
            for k, text in enumerate(texts):
                words = words_of(text)
                spans, items = automaton.scan(words)
                out[k] = (len(words), merged(out[k][1] + spans) if spans else out[k][1], out[k][2] | items)
        return out if self.blocks else [(len(words_of(t)), [], set()) for t in texts]

    def chunks(self, b: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
        """Slices of a batch with about so many bytes of text."""
        sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        at, ends = 0, np.cumsum(sizes)
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)))
            yield b.slice(at, end - at)
            at = end


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about so many bytes."""
    held, total = [], 0
    for b in batches:
        held.append(b)
        total += b.nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, cfg: Decontamination = Decontamination()) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (of words)."""
    scan = Scanner(docs.sparkSession, benchmark, cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, cfg.chunk_bytes):
            for part in scan.chunks(b, cfg.chunk_bytes):
                found = scan(part.column("text").to_pylist())
                names = [sorted(i) for _, _, i in found]
                hit = [sum(y - x for x, y in s) for _, s, _ in found]
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array([n for n, _, _ in found], pa.int64()),
                        pa.array(hit, pa.int64()),
                        pa.array(map(len, names), pa.int64()),
                        pa.array(hashlib.sha256(",".join(x).encode()).hexdigest() for x in names),
                        pa.array([h > 0 for h in hit]),
                        pa.array([",".join(f"{x}:{y}" for x, y in s) for _, s, _ in found], pa.string()),
                    ],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
                )

    kind = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


def decontaminate(docs: DataFrame, benchmark: DataFrame, cfg: Decontamination = Decontamination()) -> DataFrame:
    """docs without benchmark passages; the same columns.

    Each hit span goes, from its first word's start to its last word's end. A
    document of which at least max_coverage is hit goes whole. n_chars, if
    there, follows the text.
    """
    bound_batches(docs.sparkSession)
    scan = Scanner(docs.sparkSession, benchmark, cfg)

    def cleaned(text: str, spans: list[tuple[int, int]]) -> str:
        places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
        out, at = [], 0
        for a, b in spans:
            out.append(text[at : places[a][0]])
            at = places[b - 1][1]
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, cfg.chunk_bytes):
            for part in scan.chunks(b, cfg.chunk_bytes):
                texts = part.column("text").to_pylist()
                keep, new = [], []
                for t, (n, spans, _) in zip(texts, scan(texts)):
                    hit = sum(y - x for x, y in spans)
                    keep.append(not hit or hit < cfg.max_coverage * n)
                    new.append(cleaned(t, spans) if spans else t)
                cols = dict(zip(part.schema.names, part.columns))
                cols["text"] = pa.array(new, part.schema.field("text").type)
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([None if t is None else len(t) for t in new], cols["n_chars"].type)
                yield pa.RecordBatch.from_pydict(cols, part.schema).filter(pa.array(keep, pa.bool_()))

    return rewritten(docs, run)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(id_text(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
