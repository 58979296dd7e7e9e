import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kindred.llm import chat, mixing, tokens, toxicity, urls

from .helpers import TEXTS, awkward, empty

# ---------------------------------------------------------------- token counts


@pytest.fixture(scope="module")
def counter():
    import public_tokenizers

    return tokens.Counter(public_tokenizers.path("word_bpe_49k.json"), 1000)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_are_the_librarys(counter, library):
    rng = random.Random(1)
    bits = ["a", "B", "é", "e\u0301", "Σ", "ς", "İ", "ß", "<|endoftext|>", "<|startoftext|>", "'s", "'RE", "1", "２", " ", "\u200b", "\n", "😀", "中", "\x00", "!", "%", "ǅ", "\ufeff", "½", "the ", "ation"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(16)))
        assert counter(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    for text in [t for t in TEXTS if t] + ["a" * 3000]:
        assert counter(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_token_query(spark, library):
    import public_tokenizers

    rows = tokens.token_counts(awkward(spark).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(TEXTS) + 3 and (by[0].n_bytes, by[0].n_tokens, by[0].over_limit) == (0, 0, False)
    assert by[11].over_limit and by[11].n_bytes == len(TEXTS[11].encode())


# ---------------------------------------------------------------- mixing


def waterfill(sizes, weights, total):
    target, rest, left = {}, total, set(sizes)
    while left:
        w = sum(weights[s] for s in left)
        over = {s for s in left if rest * weights[s] / w > 2 * sizes[s]}
        if not over:
            return target | {s: rest * weights[s] / w for s in left}
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        left -= over
    return target


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(30), rng.choice(["a", "b", "b", "b", "b", "Z", "é", None])) for i in range(400)]
    rows += [rows[0], (None, "x y z", "a"), (7, None, "b"), (900, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(docs, mixing.Mix(rows_per_range=13)).toPandas()
    assert len(got) == len(rows)
    assert got["taken"].le(2 * got["size"]).all() and got["taken"].ge(0).all()
    keys = ["Z", "a", "b", "empty", "é", None]
    got["key"] = got["source"].where(got["source"].notna(), "~null")
    sizes = got.groupby("key")["size"].sum().to_dict()
    weights = {("~null" if k is None else k): (3, 1, 2)[i % 3] for i, k in enumerate(keys)}
    want = waterfill(sizes, weights, 1.5 * sum(sizes.values()))
    for k, g in got.groupby("key"):
        assert g["target"].iloc[0] == pytest.approx(want[k]) and g["source_size"].iloc[0] == sizes[k]
        assert abs(g["taken"].sum() - want[k]) <= 0.5
    again = mixing.mixture(docs.repartition(7), mixing.Mix(rows_per_range=50)).toPandas()
    order = ["doc_id", "size", "source", "taken"]
    pd.testing.assert_frame_equal(got[order].sort_values(order, ignore_index=True), again[order].sort_values(order, ignore_index=True))


def test_each_documents_share_against_brute_force(spark):
    """Documents in the order of their keys, cut where the source's budget ends."""
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(40), rng.choice(["a", "b", "b", "c"])) for i in range(300)]
    rows += [(None, "x y z", "a"), (None, "u v", "a"), (7, "one two", "b"), (7, "one two", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(rows_per_range=17)
    got = sorted((r.source, -1 if r.doc_id is None else r.doc_id, r.size, r.taken) for r in mixing.mixture(docs, mix).collect())
    keyed = docs.select("source", "doc_id", "text", mixing._key(F.col("doc_id"), F.col("text"), mix).alias("k")).collect()
    sizes, want = {}, []
    for r in keyed:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    targets = waterfill(sizes, {"a": 3, "b": 1, "c": 2}, 1.5 * sum(sizes.values()))
    for source, size in sizes.items():
        whole, left = divmod(int(targets[source] + 0.5), size)
        mine = sorted((r.k, -1 if r.doc_id is None else r.doc_id, len(r.text.split())) for r in keyed if r.source == source)
        for _, i, n in mine:
            part = min(n, left)
            left -= part
            want.append((source, i, n, whole * n + part))
    assert got == sorted(want)


def test_mixed_documents(spark):
    docs = awkward(spark).where("text is not null")
    out = mixing.mix_documents(docs)
    assert out.columns == [*docs.columns, "mix_epoch", "mix_words", "mix_taken"]
    rows = out.collect()
    assert all(len(r.text.encode().split()) == r.mix_words and r.n_chars == len(r.text) for r in rows)
    assert sum(r.mix_words for r in rows) == sum(r.taken for r in mixing.mixture(docs).collect())
    assert mixing.mix_documents(empty(spark)).count() == 0 == mixing.mixture(empty(spark)).count()
    assert mixing.mix_documents(docs.where("trim(text) = ''")).count() == 0


# ---------------------------------------------------------------- chats


def test_chats(spark):
    convs = {1: "abc", 2: "ab", 3: "abc", 4: "abd", 5: "a", 6: "x", 7: "bc", 8: "abcd"[:2] + "q"}
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", ch, 5) for c, s in convs.items() for i, ch in enumerate(s)]
    rows += [(9, 0, None, None, 5), (10, 0, "user", "", 5), (None, 0, "user", "n", 5), (11, 0, "user", "t", 5), (11, 0, "user", "t", 5)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    got = {r.conv_id: r for r in chat.format_chats(table).collect()}
    assert set(got) == {1, 4, 6, 7, 8, 9, 10, None, 11}
    assert got[1].n_copies == 2 and got[11].n_turns == 2
    assert got[4].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nd<|im_end|>\n"
    assert got[9].rendered == "<|im_start|>user\n<|im_end|>\n"
    assert chat.format_chats(table.where("false")).count() == 0
    plan = chat.format_chats(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- urls


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, path = rest[:cut], rest[cut:]
    end = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:end]


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.COM/en/7?q", "http://example.com/en/8#x", "https://b.net/de/1", "http://x.example.net/de/8",
    "http://q.org/es/", "http://q.org/es", "http://com/en/", "http://xcom/en/1", "a://b://c/d", "http://h?x=/en/", "http://É.org/fr/1",
    "http://t.org/blog/some-long-slug-of-words", "http://example.net\n/de/81", "x" * 5000 + "://h/p",
]


def test_urls(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[4], "h"), (None, URLS[4], "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urls.judge_urls(pages.select("page_id", "url")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got if r.page_id not in (0, None)}
    rules = {(at + start): (what, at, start) for what, at, start in urls.RULES}
    for i, r in by.items():
        assert (r.host, r.path) == plain_url(URLS[i])
        fits = [k for k, (_, h, p) in rules.items() if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        want = max(fits, key=len, default=None)
        assert r.rule == want and (want is None or r.verdict == rules[want][0])
        assert r.verdict in ("allow", "block")
    assert urls.judge_urls(pages.select("page_id", "url").where("false")).count() == 0


def test_templates(spark):
    """A template most of whose labelled pages are blocked is rejected; others, and unlabelled ones, are not."""
    rows = [("h.org", f"/bad/{i}", "block") for i in range(30)] + [("h.org", f"/bad/{i}", None) for i in range(5)]
    rows += [("h.org", f"/good/{i}", "allow") for i in range(30)] + [("h.org", "/good/x9", None), ("h.org", "/other", None)]
    pages = spark.createDataFrame(rows, "host string, path string, given string").withColumn("lexical", urls._lexical(F.col("path")))
    got = {"/".join(r.lexical): r for r in urls.template_verdicts(pages).collect()}
    assert got["/bad/*"].verdict == "block" and got["/good/*"].verdict == "allow" and got["/other"].verdict == "allow"
    assert got["/bad/*"].purity == pytest.approx((30 + 1.25) / (30 + 2.5))


def brute_templates(rows, cfg=urls.Templates()):
    """(host, lexical path) -> (template, verdict), by walking each host's tree node by node."""
    counts = {}
    for host, path, given in rows:
        c = counts.setdefault((host, path), [0, 0, 0])
        c[0], c[1], c[2] = c[0] + 1, c[1] + (given is not None), c[2] + (given == "block")

    def leaning(n, b):
        if not n:
            return 0
        z, p = cfg.errors, b / n
        middle, half, scale = p + z * z / (2 * n), z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5, 1 + z * z / n
        return 1 if (middle - half) / scale > 0.5 else -1 if (middle + half) / scale < 0.5 else 0

    out = {}

    def walk(items, level, name):
        branches = {}
        for path, key, c in items:
            if len(path) == level:
                out[key] = name
            else:
                branches.setdefault(path[level], []).append((path, key, c))
        forms = {}
        for seg, mine in branches.items():
            ways = {}
            for path, _, c in mine:
                nxt = path[level + 1] if len(path) > level + 1 else "<end>"
                ways[nxt] = ways.get(nxt, 0) + c[0]
            n = sum(ways.values())
            usual = max(ways, key=lambda w: (ways[w], w))
            form = "<wild>" if seg == "*" else usual if 2 * ways[usual] > n else "<many>"
            forms.setdefault(form, {})[seg] = leaning(sum(c[1] for *_, c in mine), sum(c[2] for *_, c in mine))
        for members in forms.values():
            parts = {}
            mixed = {-1, 1} <= set(members.values())
            for seg, lean in members.items():
                parts.setdefault(lean if mixed else 0, []).append(seg)
            for segs in parts.values():
                label = segs[0] if len(segs) == 1 else "{" + min(segs) + "..}"
                walk([x for g in segs for x in branches[g]], level + 1, label if level == 0 else f"{name}/{label}")

    by_host = {}
    for (host, path), c in counts.items():
        by_host.setdefault(host, []).append((path, (host, path), c))
    for items in by_host.values():
        walk(items, 0, "")
    pure = {}
    for key, name in out.items():
        p = pure.setdefault((key[0], name), [0, 0, 0])
        for i in range(3):
            p[i] += counts[key][i]
    verdicts = {}
    for key, name in out.items():
        n, labels, b = pure[key[0], name]
        neutral = cfg.smoothing + cfg.unlabelled * (n - labels)
        verdicts[key] = (name, "block" if (b + neutral / 2) / (labels + neutral) >= cfg.reject_at else "allow")
    return verdicts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_templates_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for host in ("a.com", "b.org", ""):
        for _ in range(400):
            path = ("", *(rng.choice(["en", "fr", "de", "x", "*"][: rng.randrange(2, 6)]) for _ in range(rng.randrange(4))))
            lean = 0.95 if path[1:2] in (("en",), ("x",)) else 0.1
            given = None if rng.random() < 0.4 else "block" if rng.random() < lean else "allow"
            rows.append((host, path, given))
    pages = spark.createDataFrame([(h, list(p), g) for h, p, g in rows], "host string, lexical array<string>, given string")
    got = {(r.host, tuple(r.lexical)): (r.template, r.verdict) for r in urls.template_verdicts(pages).collect()}
    assert got == brute_templates(rows)
    assert {"block", "allow"} == {v for _, v in got.values()}


def test_labels_reach_pages_without_a_rule(spark):
    """Sections of one form share a template; most of its pages are blocked by a rule, so the others are too."""
    rows = [(i, f"http://h.com/en/{i}") for i in range(60)] + [(100 + i, f"http://h.com/fr/{i}") for i in range(6)]
    rows += [(200 + i, f"http://k.com/en/{i}") for i in range(3)] + [(300 + i, f"http://k.com/fr/{i}") for i in range(60)]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[100 + i].rule is None and got[100 + i].verdict == "block" for i in range(6))
    assert all(got[300 + i].verdict == "allow" for i in range(60)) and got[200].verdict == "block"
    assert got[100].template == got[0].template == "/{en..}/*"


def test_long_paths_and_null_hosts(spark):
    rows = [(1, "http://h.com/" + "/".join("abcdefghijklmnop"[i % 16] for i in range(3000))), (2, None), (2, None), (3, "no scheme"), (4, "http:///x")]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == 5 and all(r.verdict == "allow" for r in got)
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


@pytest.mark.parametrize("sections", [100, 300])
def test_a_rare_blocked_branch_blocks_no_other(spark, sections):
    """Unlabelled sections stay allowed beside a small blocked one, however many they are."""
    rows = [("h.com", f"/en/{c}", "block") for c in "abcde"]
    rows += [("h.com", "/part" + "abcdefghij"[i // 100] + "abcdefghij"[i // 10 % 10] + "abcdefghij"[i % 10] + f"/{c}", None) for i in range(sections) for c in "abcde"]
    pages = spark.createDataFrame(rows, "host string, path string, given string").withColumn("lexical", urls._lexical(F.col("path")))
    got = urls.template_verdicts(pages).where("verdict = 'block'").collect()
    assert not [r for r in got if r.lexical[1] != "en"]


# ---------------------------------------------------------------- toxicity


def test_grams_and_scales_against_brute_force():
    """Hashed n-grams are the substrings of words, and scales the shrunk log ratios of document frequencies."""
    cfg = toxicity.Toxicity(bits=22)
    grams, rng = toxicity.Grams(cfg), random.Random(1)

    def substrings(text):
        words = "".join(c if c.isalnum() and c < "\x80" or c == "'" or c > "\x7f" else " " for c in text.lower()).encode().split()
        return {(b" " + w + b" ")[i : i + n] for w in words for n in cfg.grams for i in range(len(w) + 3 - n)}

    def hashed(gram):
        places = grams.places[len(gram)]
        return int(sum(int(grams.letters[c]) * int(p) for c, p in zip(gram, places)) % 2**64 >> (64 - cfg.bits))

    texts = ["", "a", "Bad Words here!", "it's ünder", "x" * 50, "some bad-words twice, bad words"]
    texts += [" ".join("".join(rng.choices("abcd", k=rng.randrange(1, 9))) for _ in range(20)) for _ in range(40)]
    for t in texts:
        assert set(grams(t).tolist()) == {hashed(g) for g in substrings(t)}
    toxic = [int("ab" in t) for t in texts]
    model = toxicity.Classifier(texts, toxic, cfg)
    rows = [{hashed(g) for g in substrings(t)} for t in texts]
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    for g in set().union(*rows):
        c1, c0 = (1 + sum(g in r for r, y in zip(rows, toxic) if y == k) for k in (1, 0))
        scale = np.log((c1 / (n1 + 2)) / (c0 / (n0 + 2)))
        assert (model.weight[g] != 0) <= (abs(scale) > cfg.errors * (1 / c0 + 1 / c1) ** 0.5)
    z = model.intercept + sum(float(model.weight[g]) for g in rows[-1])
    assert model.score(grams(texts[-1])) == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-5)


def test_toxicity_awkward(spark):
    """Repeated rows, clashing columns, very long texts, and a training sample bounded in bytes."""
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(12)] + [(6, 0, 1)], "doc_id long, toxic int, text int")
    small = toxicity.Toxicity(bytes_per_class=100)
    for cfg in (toxicity.Toxicity(), small):
        got = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs.select("doc_id", "text"), labels, cfg)).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)


def test_toxicity(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, marks = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(40)]
        bad = rng.random() < 0.3
        if bad:
            text[rng.randrange(40)] = rng.choice(["zorgling", "quaxter", "vilphrex"]) + rng.choice(["", "s", "ed"])
        rows.append((i, " ".join(text), "en"))
        marks.append((i, int(bad), 1))
    docs = spark.createDataFrame(rows + [(None, "zorgling", "x"), (5000, None, "x"), (5001, "", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks + [(3, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = dict((i, y) for i, y, _ in marks)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, 1) for i, y, _ in marks]
    other = toxicity.train(docs, spark.createDataFrame(flipped, "doc_id long, toxic int, quality int"))
    assert (other.weight == model.weight).all(), "held-out labels must not matter"
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, none).where("predicted = 1").count() == 0
    assert toxicity.score(docs.where("false"), model).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, sizes = docs.columns, [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == names, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    last = cp.STAGES[-1][1](spark, docs, sf)
    ran = cp.run(spark, sf)
    assert ran.columns == last.columns and ran.exceptAll(last).count() == 0 == last.exceptAll(ran).count()


def test_queries_are_registered():
    from kindred.llm import registry

    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert os.path.exists("corpus_pipeline.py")


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["op4_substring_dedup", "op6_decontamination", "op8_chat_formatting", "op10_quality_rules"])
def test_queries_against_sql(spark, name):
    import duckdb

    from kindred.llm import registry

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted(repr([(c, _plain(v)) for c, v in sorted(zip(cols, r))]) for r in cur.fetchall())
    df = registry.queries()[name](spark, sf)
    assert sorted(repr([(c, _plain(r[c])) for c in sorted(df.columns)]) for r in df.collect()) == want
