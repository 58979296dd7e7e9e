"""Reading records and links, writing results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ("entity_id", "business_name", "business_address", "country")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file with a header: all text, no quoting, empty instead of null.

    Columns come from the file's header, which is read alone.
    """
    head = spark.read.text(path).limit(1).first()
    names = head[0].split("\t") if head else list(RECORD)
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    raw = spark.read.options(sep="\t", header=True, quote="", escape="", enforceSchema=True).schema(schema).csv(path)
    return raw.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])


def with_columns(df: DataFrame, names=RECORD) -> DataFrame:
    """Only these columns; missing ones are empty."""
    have = set(df.columns)
    return df.select(*[F.col(n).cast("string").alias(n) if n in have else F.lit("").alias(n) for n in names])


def read_split(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(s1, s23) of a split, with src and s1's ordinal in the file for the order of results."""
    parts = [with_columns(read_tsv(spark, f"{folder}/{split}/{split}_source{n}.tsv")).withColumn("src", F.lit(n)) for n in (1, 2, 3)]
    s1 = parts[0].withColumn("ordinal", F.monotonically_increasing_id())
    return s1, parts[1].unionByName(parts[2])


def read_links(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(links (id1, id2), ids (id1)): ids keeps those without a link."""
    raw = read_tsv(spark, path)
    id1, lists = raw.columns[:2]
    items = F.array_distinct(F.filter(F.transform(F.split(F.col(lists), ","), lambda x: F.trim(x)), lambda x: x != ""))
    ids = raw.select(F.col(id1).alias("id1")).distinct()
    return raw.select(F.col(id1).alias("id1"), F.explode(items).alias("id2")).distinct(), ids


def read_ids(spark: SparkSession, path: str, column: str = "id1", strip: bool = True) -> DataFrame:
    """The first column's values, without blanks."""
    raw = read_tsv(spark, path)
    first = F.trim(F.col(raw.columns[0])) if strip else F.col(raw.columns[0])
    return raw.select(first.alias(column)).where(F.col(column) != "").distinct()


def read_lines(spark: SparkSession, path: str) -> tuple[str | None, DataFrame]:
    """(header, the other lines as `value`); each part of a folder may have the header."""
    lines = spark.read.text(path)
    head = lines.first()
    return (head[0] if head else None), (lines.where(F.col("value") != head[0]) if head else lines)


def count_not_utf8(spark: SparkSession, path: str) -> int:
    """Lines with bytes that aren't UTF-8. The text reader keeps a line's bytes as they are."""
    raw = spark.read.text(path).select(F.encode("value", "UTF-8").alias("b"), F.col("value").cast("binary").alias("raw"))
    return raw.where(F.try_validate_utf8(F.col("raw").cast("string")).isNull() & F.col("raw").isNotNull()).count()


def result_rows(s1: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """One row for each s1 record: its ids, sorted as text and joined by commas; empty for none."""
    lists = pairs.groupBy("id1").agg(F.array_join(F.array_sort(F.collect_set("id2")), ",").alias(name))
    rows = s1.select(F.col("entity_id").alias("source1_entity_id"), "ordinal")
    joined = rows.join(lists.withColumnRenamed("id1", "source1_entity_id"), "source1_entity_id", "left")
    return joined.fillna("", [name]).select("source1_entity_id", name, "ordinal")


_TSV = dict(sep="\t", quote="", escape="", emptyValue="", nullValue="")


def write_tsv(df: DataFrame, path: str) -> None:
    """A folder of tab-separated parts, each with the header, as `read_tsv` takes them."""
    df.write.options(header=True, **_TSV).mode("overwrite").csv(path)


def write_file(df: DataFrame, path: str) -> None:
    """One tab-separated file with one header, rows in df's order.

    The parts are written by all tasks, then copied one after the other into
    the file as streams: no task and no driver holds the rows.
    """
    spark, parts = df.sparkSession, f"{path}.parts"
    df.write.options(header=False, **_TSV).mode("overwrite").csv(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, folder = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, parts))
    fs = at.getFileSystem(conf)
    fs.delete(at, True)
    out = fs.create(at, True)
    out.write(bytearray(("\t".join(df.columns) + "\n").encode()))
    names = sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    for name in names:
        part = fs.open(jvm.org.apache.hadoop.fs.Path(folder, name))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
        part.close()
    out.close()
    fs.delete(folder, True)


def write_results(s1: DataFrame, candidates: DataFrame, matches: DataFrame, folder: str) -> None:
    """Both result tables as tab-separated files, a row for each of s1 in its order; matches must be candidates."""
    stray = matches.join(candidates.select("id1", "id2"), ["id1", "id2"], "left_anti")
    if not stray.isEmpty():
        raise ValueError("there are matches outside the candidates")
    for file, pairs, name in (("matching_results", matches, "matched_entity_ids"), ("candidate_pairs", candidates, "candidate_entity_ids")):
        write_file(result_rows(s1, pairs, name).orderBy("ordinal").drop("ordinal"), f"{folder}/{file}.tsv")


def write_probabilities(scored: DataFrame, path: str) -> None:
    scored.write.options(sep="\t", header=True, compression="gzip").mode("overwrite").csv(path)


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file."""
    at, fs = _at(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def cached(df: DataFrame, path: str) -> DataFrame:
    """df as Parquet at path, written unless it is there; choose the path by all that df depends on."""
    spark = df.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def summary_text(summary: dict) -> str:
    return json.dumps(summary, default=float, indent=1, sort_keys=True)
