"""Checks of result files, as a table of broken rules with examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADERS = {"matching": ("source1_entity_id", "matched_entity_ids"), "candidate": ("source1_entity_id", "candidate_entity_ids")}
EXAMPLES = 5


def header_problem(header: str | None, kind: str, strict: bool = False) -> str | None:
    """What is wrong with a file's first line, if anything; files so broken aren't read further."""
    if not header:
        return "empty file"
    if "\t" not in header and "," in header:
        return "comma-separated: fields must be separated by tabs"
    got = tuple(header.rstrip("\n").split("\t"))
    seen = got if strict else tuple(c.strip().lower() for c in got)
    return None if seen == HEADERS[kind] else f"unexpected header {list(got)}"


def parse(lines: DataFrame, strict: bool = False) -> DataFrame:
    """(value) lines without the header -> value, id1, ids, has_tab, n_fields. Strict drops empty list items."""
    parts = F.split("value", "\t")
    rest = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "\t")).otherwise(F.lit(""))
    ids = F.when(F.trim(rest) == "", F.array().cast("array<string>")).otherwise(F.split(rest, ","))
    ids = F.filter(ids, lambda x: x != "") if strict else ids
    return lines.select(
        "value", F.get(parts, F.lit(0)).alias("id1"), ids.alias("ids"), (F.size(parts) > 1).alias("has_tab"), F.size(parts).alias("n_fields")
    )


def broken_rules(rows: DataFrame, required: DataFrame, valid: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(rule, n, examples) of parsed rows: required has id1, valid (to check that ids exist) id2.

    Rules: malformed, duplicate_row, repeated_id, self_match, wrong_prefix,
    unknown_id, missing, unknown_row. Only broken rules appear.
    """
    good = rows.where("has_tab")
    items = good.select("id1", F.explode("ids").alias("id2"))
    own = items.where(F.col("id2").startswith("S1-")).select("id2")
    other = items.where(~F.col("id2").startswith("S1-") & ~F.col("id2").rlike("^S[23]-")).select("id2")
    wrong_shape = (~F.col("has_tab") & (F.trim("value") != "")) | ((F.col("n_fields") > 2) if strict else F.lit(False))
    found = {
        "malformed": rows.where(wrong_shape).select("value"),
        "duplicate_row": good.groupBy("id1").count().where("count > 1").select("id1"),
        "repeated_id": good.where(F.size("ids") > F.size(F.array_distinct("ids"))).select("id1").distinct(),
        "self_match": own.distinct(),
        "wrong_prefix": other.distinct(),
        "missing": required.select("id1").distinct().join(good.select("id1"), "id1", "left_anti"),
        "unknown_row": good.select("id1").distinct().join(required.select("id1"), "id1", "left_anti"),
    }
    if valid is not None:
        listed = items.where(F.col("id2").rlike("^S[23]-")).select("id2").distinct()
        found["unknown_id"] = listed.join(valid.select("id2"), "id2", "left_anti")
    out = None
    for rule, offenders in found.items():
        named = offenders.toDF("x").select(F.lit(rule).alias("rule"), "x")
        out = named if out is None else out.unionByName(named)
    # The smallest few of each rule come from a window limit, not from all offenders together.
    from pyspark.sql import Window

    ranked = out.withColumn("_r", F.row_number().over(Window.partitionBy("rule").orderBy("x"))).where(F.col("_r") <= EXAMPLES)
    examples = ranked.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("x")), ", ").alias("examples"))
    return out.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).join(examples, "rule")


def matches_outside_candidates(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id1, n): rows with matches that aren't candidates; a warning, not an error."""
    pairs = lambda df: df.select("id1", F.explode("ids").alias("id2")).distinct()
    return pairs(matched).join(pairs(candidates), ["id1", "id2"], "left_anti").groupBy("id1").agg(F.count(F.lit(1)).alias("n"))


def validate(matching, candidate, required: DataFrame, valid: DataFrame | None = None, strict: bool = False):
    """(errors, warnings) as lists of text, of two files given as (header, lines) or None."""
    errors, warnings, parsed = [], [], {}
    for kind, file in (("matching", matching), ("candidate", candidate)):
        if file is None:
            (errors if kind == "matching" or strict else warnings).append(f"{kind} file not found")
            continue
        if problem := header_problem(file[0], kind, strict):
            errors.append(f"{kind}: {problem}")
            continue
        parsed[kind] = parse(file[1], strict)
        for r in broken_rules(parsed[kind], required, valid, strict).orderBy("rule").collect():  # at most one row a rule
            errors.append(f"{kind}: {r['rule']} ({r['n']}): {r['examples']}")
    if valid is None:
        warnings.append("whether ids exist was not checked")
    if len(parsed) == 2 and (n := matches_outside_candidates(parsed["matching"], parsed["candidate"]).count()):
        warnings.append(f"{n} rows have matches that are not candidates")
    return errors, warnings
