import hashlib
import random

from kindred.llm import decontam

from .helpers import TEXTS, awkward, empty, same_columns


def brute(text, items, k=10):
    words, hit, names = decontam.words_of(text), set(), set()
    for name, item in items:
        w = decontam.words_of(item)
        n = min(k, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[j : j + n]:
                    hit |= set(range(i, i + n))
                    names.add(name)
    return len(words), hit, names


def test_automaton_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        items = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.randrange(9)))) for i in range(4)]
        text = " ".join(rng.choice("abcd") for _ in range(rng.randrange(25)))
        a = decontam.SuffixAutomaton([(n, decontam.words_of(t)) for n, t in items], 4)
        spans, names = a.scan(decontam.words_of(text))
        _, hit, want = brute(text, items, 4)
        assert {i for x, y in spans for i in range(x, y)} == hit and names == want
        assert spans == decontam.merged(spans)


def test_long_repetitive_item():
    item = "a " * 5000
    a = decontam.SuffixAutomaton([("1", decontam.words_of(item))], 10)
    assert a.scan(["a"] * 12) == ([(0, 12)], {"1"})


def _benchmark(spark, base):
    items = [(1, base[:300]), (2, "One two"), (2, "zz"), (None, "text"), (3, None), (4, ""), (5, " ".join(base.split()[5:20]))]
    return spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string"), items


def test_query(spark):
    docs = awkward(spark, TEXTS[:11] + TEXTS[12:])
    bench, items = _benchmark(spark, TEXTS[6])
    named = [("" if i is None else str(i), t) for i, t in items]
    plain = TEXTS[:11] + TEXTS[12:]
    for block in (10**6, 50):  # one automaton, and several blocks of items
        cfg = decontam.Decontamination(block_chars=block)
        rows = decontam.contamination(docs.select("doc_id", "text"), bench, cfg).collect()
        assert len(rows) == docs.count()
        for r in rows:
            text = plain[-1] if r.doc_id is None or r.doc_id >= len(plain) else plain[r.doc_id]
            n, hit, names = brute(text, named)
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(names), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_cleaning(spark):
    docs = awkward(spark)
    bench, _ = _benchmark(spark, TEXTS[6])
    out = decontam.decontaminate(docs, bench)
    assert same_columns(out, docs)
    for r in out.collect():
        assert r.text is None or (r.n_chars == len(r.text) and "alpha10 beta5" not in r.text)
    assert decontam.decontaminate(empty(spark), bench).count() == 0
    assert decontam.decontaminate(docs, bench.where("false")).count() == docs.count()
