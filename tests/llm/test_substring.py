import hashlib
import random

import numpy as np
import pytest

from kindred.llm import substring
from kindred.llm.common import word_hashes

from .helpers import TEXTS, awkward, empty


def brute(rows, k):
    """{(id, text): (words, kept)} by the definition."""
    low = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[j : j + k])
                low[key] = min(low.get(key, i), i)
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for j in range(len(w) - k + 1):
            if i is not None and low[tuple(w[j : j + k])] < i:
                gone |= set(range(j, j + k))
        out[i, t] = (len(w), [x for n, x in enumerate(w) if n not in gone])
    return out


def check(spark, rows, cfg):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.without_repeats(docs, cfg).collect()
    want = brute(rows, cfg.window)
    assert len(got) == len(rows)
    left = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got)
    right = sorted((str(i), want[i, t][0], want[i, t][0] - len(want[i, t][1]), hashlib.sha256(b" ".join(want[i, t][1])).hexdigest()) for i, t in rows)
    assert left == right


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(60):
        words = [rng.choice("abcdefgh") for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            a, at = rng.randrange(25), rng.randrange(len(words) + 1)
            words[at:at] = passage[a : a + rng.randrange(3, 20)]
        rows.append((rng.randrange(40) if i % 5 else i, " ".join(words)))
    check(spark, rows, substring.Repeats(window=6, run=3))


def test_awkward(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    check(spark, rows, substring.Repeats())
    assert substring.without_repeats(empty(spark).select("doc_id", "text")).count() == 0


def test_word_hashes():
    texts = [t.encode() for t in TEXTS if t is not None]
    hashes, owner = word_hashes(texts, 1)
    words = [w for t in texts for w in t.split()]
    assert owner.tolist() == [i for i, t in enumerate(texts) for _ in t.split()]
    known = {}
    for w, h in zip(words, hashes.tolist()):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    giant = [b"x" * 1_500_000 + b" y", b"x" * 1_500_000]
    h, _ = word_hashes(giant, 1)
    assert len(h) == 3 and h[0] == h[2] != h[1]
    assert len(word_hashes([b"", b" "], 1)[0]) == 0
    assert np.array_equal(word_hashes([b"b a"], 1)[0][::-1], word_hashes([b"a b"], 1)[0])
