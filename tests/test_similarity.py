import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import similarity as S

short = st.text("abcd ", max_size=8)


def plain_jaro_winkler(a, b):
    """The textbook definition, with half transpositions and an ungated prefix."""
    if not a or not b:
        return 0.0
    reach, taken, left = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, c in enumerate(a):
        for j in range(len(b)):
            if abs(i - j) <= reach and j not in taken and b[j] == c:
                taken.add(j)
                left.append(c)
                break
    if not left:
        return 0.0
    right = [b[j] for j in sorted(taken)]
    t = sum(x != y for x, y in zip(left, right)) / 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@settings(max_examples=500)
@given(short, short)
def test_jaro_winkler_against_the_definition(a, b):
    assert S.jaro_winkler(a, b) == pytest.approx(plain_jaro_winkler(a, b))
    assert S.jaro_winkler(a, b) == pytest.approx(S.jaro_winkler(b, a))


@pytest.mark.parametrize(
    "f, a, b, want",
    [
        (S.jaro_winkler, "martha", "marhta", 0.9611), (S.jaro_winkler, "", "", 0), (S.jaro_winkler, "a", "", 0),
        (S.jaro_winkler, "enterprises", "enterprises_", 0.983), (S.jaro_winkler, "comply", "company", 0.910),
        (S.seq_ratio, "abcd", "bcde", 0.75), (S.seq_ratio, "", "", 1), (S.seq_ratio, "a", "", 0),
        (S.token_sort_ratio, "b a", "a b", 1), (S.token_set_ratio, "a b", "a b c", 1), (S.token_set_ratio, "", "a", 0),
        (S.jaccard, ["a", "b"], ["b", "c"], 1 / 3), (S.jaccard, [], [], 0), (S.overlap, ["a", "b"], ["b", "c"], 0.5),
        (S.soft_match, ["martha", "x"], ["marhta"], 1), (S.soft_match, [], ["a"], 0), (S.soft_match, ["abc", "zzz"], ["abc", "yyy"], 0.5),
    ],
)
def test_golden(f, a, b, want):
    assert f(a, b) == pytest.approx(want, abs=6e-4)


@given(short, short)
def test_seq_ratio_is_difflib(a, b):
    want = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    assert S.seq_ratio(a, b) == (want if a and b else float(a == b))


def test_columns(spark):
    rows = spark.createDataFrame([("a b b", "b c"), ("", ""), ("a", "")], "x string, y string")
    x, y = S.tokens(F.col("x")), S.tokens(F.col("y"))
    got = rows.select(S.jaccard_col(x, y), S.overlap_col(x, y), S.extra_col(x, y), S.swapped_tokens(x, y)).collect()
    assert [tuple(r) for r in got] == [(1 / 3, 0.5, 1, True), (0, 0, 0, False), (0, 0, 1, False)]
    digits = spark.createDataFrame([("70", "709"), ("", "1"), ("3", "9")], "x string, y string")
    assert [r[0] for r in digits.select(S.contains_col(F.col("x"), F.col("y"))).collect()] == [1, -1, 0]


def test_registered_functions(spark):
    S.register(spark)
    assert spark.sql("select round(jaro_winkler('martha', 'marhta'), 4), soft_match('a b', 'a')").first()[:] == (0.9611, 1.0)
