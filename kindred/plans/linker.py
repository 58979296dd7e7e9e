"""The linkage chain: normalise, block, score twice, decide."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocking, decode, evaluate, features, model, sampling
from ..operators.windows import top_rows
from ..sources import tables
from ..sources.scratch import written
from ..sources.tables import with_columns
from .config import LinkConfig

PREPARED = ("entity_id", "src", "country_n", "name_n", "name_core", "addr_n")


def prepare(records: DataFrame) -> DataFrame:
    """Raw records (with src) -> normalised ones; an ordinal is kept if there is one."""
    extra = [c for c in ("src", "ordinal") if c in records.columns]
    raw = with_columns(records).columns
    whole = records.select(*extra, *[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in records.columns else F.lit("")).alias(c) for c in raw])
    clean = whole.select(
        "*",
        T.basic_clean(F.col("business_name")).alias("_name"),
        T.basic_clean(F.col("business_address")).alias("_addr"),
        T.basic_clean(F.col("country")).alias("country_n"),
    )
    named = clean.select("entity_id", *extra, "country_n", T.clean_name(F.col("_name")).alias("name_n"), T.clean_address(F.col("_addr")).alias("addr_n"))
    out = named.withColumn("name_core", T.core_name(F.col("name_n")))
    out = out if "src" in extra else out.withColumn("src", F.lit(1))
    return out.select(*PREPARED, *[c for c in extra if c not in PREPARED])


def prepare_once(records: DataFrame) -> DataFrame:
    """As prepare, but equal raw texts are normalised once, for tables whose rows repeat."""
    raw = ["business_name", "business_address", "country"]
    whole = records.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in raw else F.col(c) for c in records.columns])
    ready = prepare(whole.select(*raw).distinct().select(F.md5(F.concat_ws("\0", *raw)).alias("entity_id"), *raw)).drop("src")
    ready = written(ready.withColumnRenamed("entity_id", "_texts"), "texts")
    keyed = whole.withColumn("_texts", F.md5(F.concat_ws("\0", *raw))).drop(*raw)
    out = keyed.join(ready, "_texts")
    return out.select(*PREPARED, *[c for c in keyed.columns if c not in (*PREPARED, "_texts")])


def quick_match(s1: DataFrame, s23: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(id1, id2, p) without a model: the most similar core name of the country, if similar enough."""
    name = blocking.View("nm", F.col("name_core"))
    return blocking.nearest(s1, s23, name).where(F.col("sim") >= threshold).withColumnRenamed("sim", "p")


@dataclass
class Fitted:
    """Two models, the decision's settings and the cross-validated report."""

    first: model.Model
    second: model.Model
    threshold: float
    margin: float
    report: dict
    config: LinkConfig
    out_of_fold: DataFrame | None = None


class Linker:
    def __init__(self, config: LinkConfig = LinkConfig()):
        self.config = config

    def candidates(self, s1: DataFrame, s23: DataFrame) -> DataFrame:
        """Pairs with the first model's features."""
        cfg = self.config
        return written(features.cheap_features(self.blocked(s1, s23), s1, s23), "cheap")

    def blocked(self, s1: DataFrame, s23: DataFrame) -> blocking.Blocking:
        """Candidates and statistics, from the cache if these records were blocked with these settings before."""
        cfg = self.config
        if not cfg.cache:
            return blocking.block(s1, s23, scale=cfg.scale, keep=cfg.keep, encoder=cfg.encoder, dim=cfg.dim)
        # Names the contents, in any order: sums of hashes of all rows.
        sums = [r.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*PREPARED)), F.sum(F.xxhash64(*PREPARED) % 1_000_003)).first() for r in (s1, s23)]
        at = f"{cfg.cache}/blocking_{cfg.key(*map(str, sums))}"
        spark, names = s1.sparkSession, ("pairs", "s1_stats", "s23_stats")
        if not all(tables.exists(spark, f"{at}/{n}/_SUCCESS") for n in names):
            made = blocking.block(s1, s23, scale=cfg.scale, keep=cfg.keep, encoder=cfg.encoder, dim=cfg.dim)
            for n in names:
                getattr(made, n).write.mode("overwrite").parquet(f"{at}/{n}")
        return blocking.Blocking(*(spark.read.parquet(f"{at}/{n}") for n in names))

    def second_features(self, pairs: DataFrame, s1: DataFrame, s23: DataFrame) -> DataFrame:
        """The best few of each noisy record by p1, with stacked and string features."""
        best = written(top_rows(pairs, "p1", "id2", "id1", self.config.keep_second), "best")
        return features.string_features(features.stack_features(best), s1, s23, self.config.scorers)

    def fit(self, s1: DataFrame, s23: DataFrame, links: DataFrame) -> Fitted:
        """Models from prepared records and links (id1, id2).

        The first model's scores that the second one learns from are
        out-of-fold, and so are those that the threshold is chosen by.
        """
        s1, s23 = written(s1, "s1"), written(s23, "s23")
        return self._fit(self.candidates(s1, s23), s1, s23, links)

    def fit_transform(self, s1: DataFrame, s23: DataFrame, links: DataFrame) -> tuple[Fitted, DataFrame, DataFrame]:
        """(fitted, candidates, matches): fit and then transform of the same records, which are blocked once."""
        s1, s23 = written(s1, "s1"), written(s23, "s23")
        pairs = self.candidates(s1, s23)
        fitted = self._fit(pairs, s1, s23, links)
        scored = self._score(fitted, pairs, s1, s23)
        return fitted, scored, decode.decode(scored, fitted.threshold, fitted.margin)

    def _fit(self, pairs: DataFrame, s1: DataFrame, s23: DataFrame, links: DataFrame) -> Fitted:
        cfg = self.config
        links = written(sampling.links_present(links, s1, s23), "links")
        chosen = s1.where(sampling.sampled(F.col("entity_id"), cfg.share, cfg.seed)) if cfg.share < 1 else s1
        if cfg.countries:
            chosen = chosen.where(F.col("country_n").isin(*cfg.countries))
        ids = written(chosen.select(F.col("entity_id").alias("id1"), "country_n"), "ids")
        rows = sampling.touched(pairs, ids, "combo", cfg.touch_rank) if cfg.share < 1 or cfg.countries else pairs
        rows = written(sampling.label(rows, links), "rows")
        columns = features.feature_columns(rows)
        scored, first = model.out_of_fold_and_whole(rows, columns, cfg.folds_first, cfg.trees, "p1")
        scored = written(scored, "scored")
        second_rows = written(self.second_features(scored, s1, s23), "second")
        second_columns = features.feature_columns(second_rows)
        final, second = model.out_of_fold_and_whole(second_rows, second_columns, cfg.folds_second, cfg.trees, "p")
        final = written(final, "final")
        mine = links.join(ids.select("id1"), "id1", "left_semi")
        threshold, margin = evaluate.best_setting(evaluate.threshold_grid(final, mine, ids))
        scores = evaluate.entity_scores(ids, decode.decode(final, threshold, margin), mine)
        ceiling = evaluate.entity_scores(ids, final.where("y = 1"), mine)
        report = {
            **evaluate.macro_f(scores).first().asDict(),
            "ceiling": evaluate.macro_f(ceiling).first()["all"],
            "by_country": {r["country_n"]: r["f"] for r in evaluate.macro_f_by(scores, ids, "country_n").toLocalIterator()},
            "kept": {r["keep"]: r["kept_share"] for r in evaluate.prune_recall(scored.withColumn("p", F.col("p1"))).collect()},
            "threshold": threshold,
            "margin": margin,
        }
        return Fitted(first, second, threshold, margin, report, cfg, final)

    def hold_out(self, fitted: Fitted, s1: DataFrame, links: DataFrame) -> DataFrame | None:
        """(country_n, t, f): each country scored by a second model trained on all others, at its best threshold of HELD_OUT."""
        rows = fitted.out_of_fold.drop("p")
        ids = s1.select(F.col("entity_id").alias("id1"), "country_n")
        out = None
        labels = [r[0] for r in rows.select("country_n").distinct().toLocalIterator()]
        for c in labels if len(labels) > 1 else []:
            m = model.fit(rows.where(F.col("country_n") != c), fitted.second.columns, fitted.config.trees)
            scored = m.score(rows.where(F.col("country_n") == c))
            mine = ids.where(F.col("country_n") == c)
            own = links.join(mine.select("id1"), "id1", "left_semi")
            grid = evaluate.threshold_grid(scored, own, mine, evaluate.HELD_OUT, (0.0,))
            part = grid.orderBy(F.round("f", 12).desc(), "t").limit(1).select(F.lit(c).alias("country_n"), "t", "f")
            out = part if out is None else out.unionByName(part)
        return out

    def score(self, fitted: Fitted, s1: DataFrame, s23: DataFrame) -> DataFrame:
        """(id1, id2, p) of the pairs that the second model sees: the candidates of the result."""
        s1, s23 = written(s1, "s1"), written(s23, "s23")
        return self._score(fitted, self.candidates(s1, s23), s1, s23)

    def _score(self, fitted: Fitted, pairs: DataFrame, s1: DataFrame, s23: DataFrame) -> DataFrame:
        rows = self.second_features(fitted.first.score(pairs, "p1"), s1, s23)
        return written(fitted.second.score(rows).select("id1", "id2", "p"), "result")

    def transform(self, fitted: Fitted, s1: DataFrame, s23: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(candidates, matches)."""
        scored = self.score(fitted, s1, s23)
        return scored, decode.decode(scored, fitted.threshold, fitted.margin)


def save(fitted: Fitted, folder: str) -> None:
    """Both models with Spark ML's writers, the out-of-fold rows as Parquet, the report and the rest as JSON."""
    if fitted.out_of_fold is not None:
        fitted.out_of_fold.write.mode("overwrite").parquet(f"{folder}/out_of_fold")
    tables.write_text(SparkSession.active(), tables.summary_text({**fitted.report, "config": asdict(fitted.config)}), f"{folder}/summary.json")
    for name, m in (("first", fitted.first), ("second", fitted.second)):
        if m.fitted is not None:
            m.fitted.write().overwrite().save(f"{folder}/{name}")
    s = SparkSession.active()
    row = {
        "threshold": float(fitted.threshold), "margin": float(fitted.margin), "first": fitted.first.columns,
        "second": fitted.second.columns, "rates": [float(fitted.first.rate), float(fitted.second.rate)],
        "has": [fitted.first.fitted is not None, fitted.second.fitted is not None],
    }
    kind = "threshold double, margin double, first array<string>, second array<string>, rates array<double>, has array<boolean>"
    s.createDataFrame([row], kind).coalesce(1).write.mode("overwrite").json(f"{folder}/settings")


def load(folder: str, config: LinkConfig = LinkConfig()) -> Fitted:
    from pyspark.ml.classification import GBTClassificationModel

    row = SparkSession.active().read.json(f"{folder}/settings").first()
    models = [
        model.Model(list(row[n]), GBTClassificationModel.load(f"{folder}/{n}") if has else None, rate)
        for n, has, rate in zip(("first", "second"), row["has"], row["rates"])
    ]
    return Fitted(*models, row["threshold"], row["margin"], {}, config)
