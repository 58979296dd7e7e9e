"""URL filters: host and path rules first, then a path-template tree learnt from what they say.

Each host's paths form a tree of segments. Segments that vary (numbers, long
hexadecimal or slug-like strings) become a wildcard. From the root down, the
branches of a node that are statistically alike are merged into one: branches
with the same usual continuation (what most of their pages go on with), unless
their labels disagree. A branch leans to "block" or "allow" if the Wilson
interval of its blocked share lies on one side of a half; where both leanings
occur among branches of one form, each leaning is merged for itself, and so are
those without one. The next level is judged on the merged nodes.

The labels are the rules' own verdicts. A template is rejected if its purity,
the smoothed share of blocked labels, is high; each page without a label weighs
a little against either verdict. So a page that no rule fits is blocked where
most pages of its template are blocked by rules, and a few blocked pages can't
speak for many others.

Pages are reduced to different paths before anything is grouped, so a host with
a third of all pages weighs as much as its number of different paths.

Defined results: a null url, or one without "://", has an empty host and path;
no rule fits it and its template is that of the empty host; repeated rows are
judged alike and count each as a label; of equally usual continuations the
greater counts; segments beyond `depth` are kept together as one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, forget, materialize, table

#: (verdict, host, path), a fixed list.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
_VARIABLE = r"[0-9]|^[0-9a-fA-F]{12,}$|^.{40,}$|(-[^-]*){4,}"


@dataclass(frozen=True)
class Templates:
    rules: tuple[tuple[str, str, str], ...] = RULES
    #: Levels of the tree.
    depth: int = 8
    #: Half the width of the Wilson interval, in standard errors.
    errors: float = 1.96
    #: Neutral labels that every template has, and that each page without a label adds.
    smoothing: float = 2.0
    unlabelled: float = 0.1
    reject_at: float = 0.8


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """(rule as written, verdict) of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(at + start)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _lexical(path: Column) -> Column:
    """The path's segments, variable ones as wildcards."""
    return F.transform(F.split(path, "/"), lambda s: F.when(s.rlike(_VARIABLE), F.lit("*")).otherwise(s))


def _leaning(blocked: Column, labelled: Column, cfg: Templates) -> Column:
    """1 for block, -1 for allow, 0 if the Wilson interval of the share holds a half, or there are no labels."""
    n, z = labelled.cast("double"), F.lit(cfg.errors)
    share = blocked / n
    middle, half = share + z * z / (2 * n), z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.when(labelled == 0, 0).when((middle - half) / scale > 0.5, 1).when((middle + half) / scale < 0.5, -1).otherwise(0)


_SUMS = ("n", "labelled", "blocked")


def _merged(rows: DataFrame, level: int, cfg: Templates) -> DataFrame:
    """rows (host, lexical, segments, n, labelled, blocked, template) with the template one level longer."""
    at = F.get("segments", F.lit(level))
    going = rows.where(F.size("segments") > level).withColumn("segment", at)
    node = ["host", "template"]
    ways = going.groupBy(*node, "segment", F.coalesce(F.get("segments", F.lit(level + 1)), F.lit("<end>")).alias("next"))
    ways = ways.agg(*[F.sum(c).alias(c) for c in _SUMS])
    branches = ways.groupBy(*node, "segment").agg(*[F.sum(c).alias(c) for c in _SUMS], F.max(F.struct("n", "next")).alias("usual"))
    # A wildcard is merged already.
    form = F.when(F.col("segment") == "*", "<wild>").when(F.col("usual.n") * 2 > F.col("n"), F.col("usual.next")).otherwise("<many>")
    branches = branches.select(*node, "segment", form.alias("form"), _leaning(F.col("blocked"), F.col("labelled"), cfg).alias("leaning"))
    kinds = branches.groupBy(*node, "form").agg(F.min("leaning").alias("low"), F.max("leaning").alias("high"))
    part = F.when((F.col("low") == -1) & (F.col("high") == 1), F.col("leaning")).otherwise(0)
    parted = branches.join(kinds, [*node, "form"]).select(*node, "segment", "form", part.alias("part"))
    groups = parted.groupBy(*node, "form", "part").agg(F.count(F.lit(1)).alias("k"), F.min("segment").alias("least"))
    name = F.when(F.col("k") > 1, F.concat(F.lit("{"), "least", F.lit("..}"))).otherwise(F.col("segment"))
    names = parted.join(groups, [*node, "form", "part"]).select(*node, "segment", name.alias("name"))
    longer = F.when(F.col("name").isNull(), F.col("template")).otherwise(
        F.col("name") if level == 0 else F.concat("template", F.lit("/"), "name")
    )
    joined = rows.withColumn("segment", at).join(names, [*node, "segment"], "left")
    return joined.select("host", "lexical", "segments", *_SUMS, longer.alias("template"))


def template_verdicts(pages: DataFrame, cfg: Templates = Templates()) -> DataFrame:
    """pages (host, lexical, given) -> (host, lexical, template, purity, verdict), a row for each lexical path."""
    paths = pages.groupBy("host", "lexical").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("given").alias("labelled"),
        F.count(F.when(F.col("given") == "block", 1)).alias("blocked"),
    )
    head = F.slice("lexical", F.lit(1), F.lit(cfg.depth - 1))
    tail = F.array_join(F.slice("lexical", F.lit(cfg.depth), F.greatest(F.size("lexical"), F.lit(1))), "/")
    segments = F.when(F.size("lexical") > cfg.depth, F.array_append(head, tail)).otherwise(F.col("lexical"))
    rows = materialize(paths.select("host", "lexical", segments.alias("segments"), *_SUMS, F.lit("").alias("template")), "paths")
    levels = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(levels):
        before, rows = rows, materialize(_merged(rows, level, cfg), "paths")
        forget(before)
    pure = rows.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in _SUMS])
    neutral = cfg.smoothing + cfg.unlabelled * (F.col("n") - F.col("labelled"))
    pure = pure.select("host", "template", ((F.col("blocked") + neutral / 2) / (F.col("labelled") + neutral)).alias("purity"))
    verdict = F.when(F.col("purity") >= cfg.reject_at, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("host", "lexical", "template").join(pure, ["host", "template"]).withColumn("verdict", verdict)


def judge_urls(pages: DataFrame, cfg: Templates = Templates()) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict, template, purity."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, given = rule_of(F.col("host"), F.col("path"), cfg.rules)
    parts = parts.select("*", rule.alias("rule"), given.alias("given"), _lexical(F.col("path")).alias("lexical"))
    learnt = template_verdicts(parts, cfg).select(
        F.col("host").alias("_host"), F.col("lexical").alias("_lexical"), "template", "purity", F.col("verdict").alias("_verdict")
    )
    # A left join whose left side, which hosts may skew, can be split.
    judged = parts.join(learnt, (F.col("host") == F.col("_host")) & (F.col("lexical") == F.col("_lexical")), "left")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("given", "_verdict", F.lit("allow")).alias("verdict"), "template", "purity"
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", F.col("url").cast("string")))
