"""String similarity: plain kernels for Python workers, native set measures for columns."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- kernels


def jaro_winkler(a: str, b: str, gate: float | None = None, floor_swaps: bool = False, both_empty: float = 0.0) -> float:
    """Jaro-Winkler similarity.

    gate: the prefix counts only above this Jaro similarity (None: always).
    floor_swaps: halves of the transpositions are rounded down. SQL engines
    differ in both; `gate=0.7, floor_swaps=True` is DuckDB's function.
    """
    if not a or not b:
        return both_empty if a == b else 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        free.setdefault(c, []).append(j)
    partners: list[tuple[int, str]] = []
    for i, c in enumerate(a):
        places = free.get(c)
        if places:
            k = bisect_left(places, i - reach)
            if k < len(places) and places[k] <= i + reach:
                partners.append((places.pop(k), c))
    n = len(partners)
    if not n:
        return 0.0
    swapped = sum(c != d for (_, c), (_, d) in zip(partners, sorted(partners)))
    swaps = swapped // 2 if floor_swaps else swapped / 2
    jaro = (n / len(a) + n / len(b) + (n - swaps) / n) / 3
    if gate is not None and jaro <= gate:
        return jaro
    prefix = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro)


def seq_ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity; not symmetric."""
    if bool(a) != bool(b):
        return 0.0
    return SequenceMatcher(None, a, b, autojunk=False).ratio() if a else 1.0


def token_sort_ratio(a: str, b: str, ratio: Callable[[str, str], float] = seq_ratio) -> float:
    return ratio(*(" ".join(sorted(s.split())) for s in (a, b)))


def token_set_ratio(a: str, b: str, ratio: Callable[[str, str], float] = seq_ratio) -> float:
    """The best of: common tokens against each side, and the sides, common tokens first."""
    x, y = set(a.split()), set(b.split())
    if not (x and y):
        return 0.0
    spell = lambda tokens: " ".join(sorted(tokens))
    common = spell(x & y)
    left, right = ((common + " " + spell(own)).strip() for own in (x - y, y - x))
    pairs = [(left, right)] + ([(common, left), (common, right)] if common else [])
    return max(ratio(*p) for p in pairs)


def jaccard(a: Sequence[str] | set, b: Sequence[str] | set) -> float:
    either = set(a) | set(b)
    return len(set(a) & set(b)) / len(either) if either else 0.0


def overlap(a: Sequence[str] | set, b: Sequence[str] | set) -> float:
    least = min(len(set(a)), len(set(b)))
    return len(set(a) & set(b)) / least if least else 0.0


@lru_cache(maxsize=200_000)
def _token_jw(a: str, b: str) -> float:
    return jaro_winkler(a, b)


def soft_match(a: Sequence[str], b: Sequence[str], least: float = 0.88) -> float:
    """Share of the shorter list's tokens with a partner of at least this Jaro-Winkler similarity."""
    few, many = (b, a) if len(a) > len(b) else (a, b)
    if not few:
        return 0.0
    known = set(many)
    found = lambda t: t in known or any(abs(len(t) - len(u)) <= 3 and _token_jw(t, u) >= least for u in many)
    return sum(map(found, few)) / len(few)


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; 1 if both are empty. Symmetric, unlike seq_ratio."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], above + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def scorers(kind: str = "plain") -> dict[str, Callable[..., float]]:
    """The string kernels of a kind: "plain", or "gated" (prefix boost above 0.7 only, whole transpositions, indel ratio)."""
    if kind == "plain":
        return {"jaro_winkler": jaro_winkler, "ratio": seq_ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio}
    if kind != "gated":
        raise ValueError(f"unknown scorers {kind!r}; known: plain, gated")
    gated = lambda a, b: jaro_winkler(a, b, gate=0.7, floor_swaps=True)
    by_token = lambda f: lambda a, b: f(a, b, indel_ratio)
    return {"jaro_winkler": gated, "ratio": indel_ratio, "token_sort": by_token(token_sort_ratio), "token_set": by_token(token_set_ratio)}


# ---------------------------------------------------------------- columns


def pairwise(kernel: Callable[..., float]):
    """A pandas UDF of two string columns; null counts as empty."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([kernel(x or "", y or "") for x, y in zip(a, b)], dtype="float64")

    return run


def register(spark) -> None:
    """Make the kernels SQL functions: jaro_winkler, seq_ratio, token_sort_ratio, token_set_ratio, soft_match."""
    for f in (jaro_winkler, seq_ratio, token_sort_ratio, token_set_ratio):
        spark.udf.register(f.__name__, pairwise(f))
    spark.udf.register("soft_match", pairwise(lambda a, b: soft_match(a.split(), b.split())))


def tokens(c: Column) -> Column:
    """The space-separated tokens of a normalised text; none for an empty one."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda t: t != F.lit(""))


def jaccard_col(a: Column, b: Column) -> Column:
    """Of arrays; 0 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))


def overlap_col(a: Column, b: Column) -> Column:
    """Of arrays; 0 if one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def extra_col(a: Column, b: Column) -> Column:
    """How many different elements of a are not in b."""
    return F.size(F.array_except(a, b))


def contains_col(a: Column, b: Column) -> Column:
    """1 if one text contains the other, 0 if not, -1 if either is empty."""
    return F.when((a == "") | (b == ""), F.lit(-1.0)).otherwise((F.contains(a, b) | F.contains(b, a)).cast("double"))


def any_contains_col(a: Column, b: Column) -> Column:
    """1 if any element of one array contains one of the other, 0 if not, -1 if either array is empty."""
    found = F.exists(a, lambda x: F.exists(b, lambda y: F.contains(x, y) | F.contains(y, x)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(-1.0)).otherwise(found.cast("double"))


def swapped_tokens(a: Column, b: Column) -> Column:
    """Whether two token arrays differ by exactly one token each way."""
    return (extra_col(a, b) == 1) & (extra_col(b, a) == 1)
