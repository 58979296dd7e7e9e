"""Reports: data quality, link structure, missed links, token swaps, side-by-side views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import jaro_winkler, pairwise, swapped_tokens, tokens
from .windows import top_rows


def quality_profile(sources: dict[str, DataFrame]) -> DataFrame:
    """One row a source: rows, different and repeated ids, ids of another source's prefix, empty texts."""

    def one(prefix: str, df: DataFrame) -> DataFrame:
        empty = lambda c: F.avg((F.trim(F.coalesce(F.col(c), F.lit(""))) == "").cast("double"))
        return df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct("entity_id").alias("n_ids"),
            F.count(F.when(~F.col("entity_id").startswith(prefix), 1)).alias("n_bad_prefix"),
            empty("business_name").alias("empty_name"),
            empty("business_address").alias("empty_address"),
            F.count_distinct("country").alias("n_countries"),
        ).select(F.lit(prefix).alias("source"), "*", (F.col("n_rows") - F.col("n_ids")).alias("n_repeated"))

    return reduce(DataFrame.unionByName, (one(p, d) for p, d in sources.items()))


def only_in(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values of a column that occur in a and not in b."""
    return a.select(column).distinct().join(b.select(column).distinct(), column, "left_anti")


def link_structure(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(n_links, n_ids): how many id1 have so many links."""
    counts = links.groupBy("id1").agg(F.count_distinct("id2").alias("n"))
    each = ids.select("id1").join(counts, "id1", "left")
    return each.groupBy(F.coalesce("n", F.lit(0)).alias("n_links")).agg(F.count(F.lit(1)).alias("n_ids"))


def shared_links(links: DataFrame) -> DataFrame:
    """(id2, n): records that belong to more than one id1."""
    return links.groupBy("id2").agg(F.count_distinct("id1").alias("n")).where("n > 1")


def missed_links(links: DataFrame, pairs: DataFrame) -> DataFrame:
    return links.join(pairs.select("id1", "id2"), ["id1", "id2"], "left_anti")


def side_by_side(pairs: DataFrame, s1: DataFrame, s23: DataFrame, columns=("name_n", "addr_n")) -> DataFrame:
    left = s1.select(F.col("entity_id").alias("id1"), *[F.col(c).alias(f"{c}_1") for c in columns])
    right = s23.select(F.col("entity_id").alias("id2"), *[F.col(c).alias(f"{c}_2") for c in columns])
    return pairs.join(left, "id1").join(right, "id2")


def errors(predicted: DataFrame, links: DataFrame) -> DataFrame:
    """(id1, id2, kind): false positives and false negatives."""
    fp = predicted.select("id1", "id2").join(links, ["id1", "id2"], "left_anti").withColumn("kind", F.lit("fp"))
    fn = links.select("id1", "id2").join(predicted, ["id1", "id2"], "left_anti").withColumn("kind", F.lit("fn"))
    return fp.unionByName(fn)


def worst(scored: DataFrame, value: str, per: str, n: int = 30) -> DataFrame:
    """The n groups with the highest value, a row for each."""
    return top_rows(scored, value, per, "id2", 1).orderBy(F.col(value).desc(), "id1", "id2").limit(n)


def token_swaps(pairs: DataFrame, a: str, b: str, least: int = 3, unlike: float | None = None, kernel=jaro_winkler) -> DataFrame:
    """(token_1, token_2, n): single tokens that stand for each other in at least `least` pairs of texts.

    With `unlike`, only tokens whose similarity is below it: not spellings of one word.
    A row may stand for as many pairs as its column `copies` says.
    """
    x, y = tokens(F.col(a)), tokens(F.col(b))
    many = (F.col("copies") if "copies" in pairs.columns else F.lit(1)).cast("long").alias("copies")
    one = pairs.where(swapped_tokens(x, y)).select(
        many,
        F.array_sort(F.array(F.get(F.array_except(x, y), F.lit(0)), F.get(F.array_except(y, x), F.lit(0)))).alias("t")
    )
    counts = one.groupBy(F.get("t", F.lit(0)).alias("token_1"), F.get("t", F.lit(1)).alias("token_2"))
    found = counts.agg(F.sum("copies").alias("n")).where(F.col("n") >= least)
    return found if unlike is None else found.where(pairwise(kernel)("token_1", "token_2") < unlike)


def top_tokens(records: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent tokens of a column: a report, so its limit is the feature."""
    words = records.select(F.explode(tokens(F.col(column))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "token").limit(n)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, n) of a column between 0 and 1."""
    cell = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, standard deviation, least, exact quartiles and most of a column."""
    c = F.col(column)
    quartile = lambda q: F.percentile(c, F.lit(q)).alias(f"q{int(q * 100)}")
    return df.agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("least"),
        quartile(0.25), quartile(0.5), quartile(0.75), F.max(c).alias("most"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) of a column."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    whole = df.agg(F.count(F.lit(1)).alias("_all"))  # one row
    return counts.join(F.broadcast(whole)).select(column, "n", (F.col("n") / F.col("_all")).alias("share"))


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts of `rows` by the given values of `columns`, 0 where there are none."""
    return df.groupBy(rows).agg(*[F.count(F.when(F.col(columns) == v, 1)).alias(v) for v in values])


def pair_histograms(links: DataFrame, records: DataFrame, kernel=jaro_winkler, bins: int = 20) -> DataFrame:
    """(kind, bin, n): similarities of core names, of linked pairs ("true") and of as many random ones ("random").

    A random pair is a link's id1 with the id2 of the next link by a hash of
    the pair, in the same bucket of such hashes; nothing is sorted in one task.
    """
    from pyspark.sql import Window

    key = F.xxhash64("id1", "id2")
    buckets = Window.partitionBy(F.pmod(key, F.lit(1024))).orderBy(key, "id1", "id2")
    true = links.select("id1", "id2")
    random = true.withColumn("other", F.lead("id2").over(buckets)).where("other is not null").select("id1", F.col("other").alias("id2"))
    both = true.withColumn("kind", F.lit("true")).unionByName(random.withColumn("kind", F.lit("random")))
    named = lambda i, n: records.select(F.col("entity_id").alias(i), F.col("name_core").alias(n))
    texts = both.join(named("id1", "_a"), "id1").join(named("id2", "_b"), "id2")
    cell = F.least(F.floor(pairwise(kernel)("_a", "_b") * bins), F.lit(bins - 1)).cast("int")
    return texts.groupBy("kind", cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
