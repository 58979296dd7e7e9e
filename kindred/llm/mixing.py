"""Mixing sources to target weights.

Each document gets a uniform hash key. Within its source the documents are
ordered by that key, prefix sums of their sizes are computed in two levels
(inside equal-width key ranges, and over the ranges' totals), and the source is
cut at its exact budget; a budget above the source's size takes whole epochs
first. No step orders a whole source in one task.

Defined results: null text has size 0 and nothing is taken from it; a null
source is a source of its own, ordered last; equal rows keep their own places
(ties in the key are ordered by id, then size, and each row counts); rows
without an id take their key from the text; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, col, materialize, table


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (3, 1, 2)
    #: The mix has this share of all sizes.
    share: float = 1.5
    #: No source gives more than this many times its size.
    epochs: float = 2.0
    #: Rows that one range of keys holds on average.
    rows_per_range: int = 5000
    #: A table of sources or ranges of at most so many rows (of a few dozen bytes, and the source's name) goes to all tasks.
    sent_rows: int = 50_000
    seed: int = 7


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, source_size, n_rows) -> the same with target, by water-filling.

    Giving each source its weight's share, stopping at the limit and resharing
    the excess ends with target = min(limit, level * weight) for one level, which
    sorted limits and running sums give without iterating.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    ranked = sizes.withColumn("_w", F.get(weights, (F.row_number().over(order) - 1) % len(mix.weights)))
    ranked = ranked.withColumn("_limit", F.col("source_size") * F.lit(float(mix.epochs)))
    by_level = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    summed = ranked.withColumns(
        {
            "_total": F.sum("source_size").over(everything) * F.lit(float(mix.share)),
            "_capped": F.coalesce(F.sum("_limit").over(before), F.lit(0.0)),
            "_rest_w": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
        }
    )
    level = (F.col("_total") - F.col("_capped")) / F.col("_rest_w")
    # The level is that of the first source, in this order, which it doesn't fill; after it, it would only fall.
    is_open = level * F.col("_w") < F.col("_limit")
    found = summed.withColumn("_level", F.max(F.when(is_open, level)).over(everything))
    target = F.least(F.col("_limit"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_limit")))
    return found.withColumn("target", target).select("source", "source_size", "n_rows", "target")


def cut(rows: DataFrame, mix: Mix = Mix(), narrow: DataFrame | None = None) -> DataFrame:
    """rows has source, size, _key (0 <= key < 1) and _tie; adds source_size, target, taken.

    All other columns are carried along, dealt out once. `narrow` has source,
    size and _key of the same rows, as a table that is cheap to read.
    """
    narrow = rows if narrow is None else narrow
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    aims = targets(sizes, mix).withColumn("_ranges", F.ceil(F.col("n_rows") / mix.rows_per_range))
    aims = _small(materialize(aims, "aims"), mix)
    ranged = lambda df: _with_source(df, aims).withColumn("_range", F.floor(F.col("_key") * F.col("_ranges")))
    totals = ranged(narrow.select("source", "size", "_key")).groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("source").alias("_source"),
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
    )
    offsets = _small(materialize(offsets, "offsets"), mix)
    joined = ranged(rows).join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r")))
    inside = Window.partitionBy("source", "_range").orderBy("_key", "_tie", "size")
    end = F.col("_offset") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_end") - F.col("size"))))
    out = joined.withColumn("_end", end).withColumn("taken", (whole * F.col("size") + part).cast("long"))
    return out.drop("_end", "_offset", "_source", "_r", "_range", "_ranges", "n_rows")


def _small(table: DataFrame, mix: Mix) -> DataFrame:
    """The table, sent to all tasks if its rows, counted, are few: the large side then stays where it is."""
    return F.broadcast(table) if table.count() <= mix.sent_rows else table


def _with_source(rows: DataFrame, aims: DataFrame) -> DataFrame:
    named = aims.withColumnRenamed("source", "_s")
    return rows.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _key(doc_id: Column, text: Column, mix: Mix) -> Column:
    """Uniform in [0, 1): 53 bits of a hash of the id, or of the text where there is no id."""
    hashed = F.xxhash64(F.lit(mix.seed), doc_id, F.when(doc_id.isNull(), text))
    return F.shiftrightunsigned(hashed, 11) / F.lit(float(2**53))


def mixture(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken.

    Texts are read once; all later steps work on a written table of sizes.
    """
    doc_id = col("doc_id")
    rows = docs.select(
        doc_id.alias("doc_id"),
        col("source").cast("string").alias("source"),
        size_of(col("text")).alias("size"),
        _key(doc_id, col("text"), mix).alias("_key"),
        F.coalesce(doc_id.cast("long"), F.lit(-1)).alias("_tie"),
    )
    mixed = cut(materialize(rows, "sizes"), mix)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: a row for each time a document is taken, `epoch` from 0.

    The columns of docs, then mix_epoch, mix_words (of this copy) and mix_taken,
    with an underscore after the name where docs has such a column itself. Where the
    budget ends inside a document, its last copy has only the first words,
    joined by one space, and n_chars follows. The texts travel with the keys to
    their ranges, one shuffle; rows need no unique id.
    """
    names = docs.columns
    doc_id = col("doc_id")
    rows = docs.select(
        F.struct(*[col(c) for c in names]).alias("_row"),
        col("source").cast("string").alias("source"),
        size_of(col("text")).alias("size"),
        _key(doc_id, col("text"), mix).alias("_key"),
        F.coalesce(doc_id.cast("long"), F.lit(-1)).alias("_tie"),
    )
    narrow = materialize(rows.select("source", "size", "_key"), "sizes")
    mixed = cut(rows, mix, narrow).where("taken > 0")
    copies = mixed.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")))).alias("_epoch")
    )
    words = F.least(F.col("size"), F.col("taken") - F.col("_epoch") * F.col("size"))
    all_words = F.filter(F.split(F.col("_row")["text"], SPACE + "+"), lambda w: w != F.lit(""))
    copies = copies.withColumn("_words", words)
    text = F.when(F.col("_words") == F.col("size"), F.col("_row")["text"]).otherwise(
        F.array_join(F.slice(all_words, F.lit(1), F.col("_words").cast("int")), " ")
    )
    copies = copies.withColumn("_text", text)
    put = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    added = {"mix_epoch": F.col("_epoch"), "mix_words": F.col("_words"), "mix_taken": F.col("taken")}
    return copies.select(
        *[put.get(c, F.col("_row")[c]).alias(c) for c in names], *[value.alias(_free(name, names)) for name, value in added.items()]
    )


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))
