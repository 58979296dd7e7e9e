"""Token counts by byte-pair merging with a heap and a linked list.

A word's symbols form a linked list; the adjacent pairs with a merge rank wait
in a heap; the lowest-ranked pair (leftmost among equals) is popped, merged, and
its new neighbours pushed. The count is the number of initial symbols minus the
merges; ids are never made. Counts of words already seen are remembered in a
bounded table.

The vocabulary file is public and stays where it is: its path is a parameter.

The files served are those with this one's kind of normalising (composed, lower
case) and pre-tokenizer (a split by a pattern, then bytes).

Defined results: null text counts as empty, with no bytes and no tokens;
strings of special tokens inside a text count one token each, as the library
does by default.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, table


@dataclass(frozen=True)
class TokenCounts:
    vocabulary: str = "word_bpe_49k.json"
    limit: int = 2048
    remembered: int = 200_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b if b in plain else extra)
        extra += b not in plain
    return out


class Counter:
    """Counts tokens of texts for one vocabulary file of the tokenizers library."""

    def __init__(self, path: str, remembered: int):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        # The longest of those that begin at one place.
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)) or "(?!)")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.bytes = byte_symbols()
        self.known: dict[str, int] = {}
        self.remembered = remembered

    def merges(self, symbols: list[str]) -> int:
        """How many merges the ranks allow, lowest rank first."""
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one side has been merged meanwhile
            done += 1
            symbols[i], symbols[j] = a + b, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := ranks.get((symbols[left], symbols[right]))) is not None:
                    heapq.heappush(heap, (r, left, symbols[left], symbols[right]))
        return done

    def word(self, word: str) -> int:
        if (n := self.known.get(word)) is None:
            symbols = [self.bytes[b] for b in word.encode("utf-8", "replace")]
            symbols[-1] += self.suffix
            symbols = [s for s in symbols if s in self.vocab]
            n = len(symbols) - self.merges(symbols)
            if len(self.known) >= self.remembered:
                self.known.clear()
            if len(word) <= 64:
                self.known[word] = n
        return n

    def __call__(self, text: str) -> int:
        total, known, word = 0, self.known, self.word
        specials = self.special.findall(text)
        for part in self.special.split(text) if specials else [text]:
            # Each character is lowered by itself: no final sigma.
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for w in self.words.findall(part):
                n = known.get(w)
                total += word(w) if n is None else n
        return total + len(specials)


@lru_cache(maxsize=2)
def counter(path: str, remembered: int) -> Counter:
    return Counter(path, remembered)


def token_counts(docs: DataFrame, path: str, cfg: TokenCounts = TokenCounts()) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit. path is read where the tasks run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, cfg.remembered)
        for b in batches:
            n = [count(t) if (t := x.as_py()) else 0 for x in b.column("text")]
            cols = [b.column("doc_id"), pa.array(n, pa.int64())]
            yield pa.record_batch([cols[0], b.column("n_bytes"), cols[1]], ["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    counted = docs.select(F.col("doc_id").cast("long"), "text", n_bytes).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > cfg.limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cfg = TokenCounts()
    return token_counts(id_text(table(spark, sf_dir, "documents")), public_tokenizers.path(cfg.vocabulary), cfg)
