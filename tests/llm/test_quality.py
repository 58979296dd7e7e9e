import re
from collections import Counter

from pyspark.sql import functions as F

from kindred.llm import quality

from .helpers import TEXTS, awkward, empty, same_columns


def brute(text):
    words = [w.decode() for w in (text or "").encode().split()]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed)


def test_against_brute_force(spark):
    docs = awkward(spark)
    rows = quality.quality(docs).collect()
    texts = dict(enumerate([*TEXTS, TEXTS[-1]])) | {None: TEXTS[-1]}
    assert len(rows) == docs.count()
    for r in rows:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.kept and r.base_failed)


def test_lines(spark):
    good = "A plain sentence stands here, with some words in it.\n"
    text = good * 1 + "Home | News | About | Contact\nPlease enable JavaScript to go on.\nMenu\n" + "Another one follows after it, which says other things entirely.\n"
    bad = "one | two | three | four | five\n" * 1 + "six | seven | eight | nine | ten | eleven | twelve"
    docs = spark.createDataFrame([(1, text), (2, bad)], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert rows[1].kept and "JavaScript" not in rows[1].clean_text and "Home" not in rows[1].clean_text and "Menu" not in rows[1].clean_text
    assert not rows[2].base_failed and not rows[2].kept


def test_cleaning_keeps_columns(spark):
    docs = awkward(spark)
    out = quality.clean_documents(docs)
    assert same_columns(out, docs)
    kept = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    assert {r.doc_id for r in out.collect()} == kept
    assert out.where(F.col("n_chars") != F.length("text")).count() == 0
    assert quality.clean_documents(empty(spark)).count() == 0 == quality.quality(empty(spark)).count()


def test_native(spark):
    plan = quality.clean_documents(awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_boilerplate_glued_to_other_letters(spark):
    """A phrase fails its line wherever it stands, and the text's pre-test misses none that the pattern finds."""
    phrases = [
        "Lorem Ipsum", "enable JavaScript", "javascript is disabled", "JavaScript required", "javascript disabled", "javascript is required",
        "cookie policy", "Cookie Settings", "accept all cookies", "accept cookies", "Privacy Policy", "terms of use", "Terms of Service",
        "ALL RIGHTS RESERVED", "click here to", "sign in to", "log in to continue", "subscribe to our newsletter",
    ]
    good = "This is a plain line with a good many words in it, and it stays. It is long enough for the rules."
    rows = [(i, f"{good}\n{glue}{p} and so on.") for i, (p, glue) in enumerate((p, g) for p in phrases for g in ("", "2024", "Home", "x_", "(c) "))]
    got = quality.clean_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r.text for r in got} == {good}
