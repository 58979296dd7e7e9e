"""More queries over the driver's tables, with SQL: three-view blocking, pair features, decisions, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..functions import vocab
from ..operators import blocking, decode, diagnostics, evaluate, features, members, sampling, windows
from ..sources import tables
from ..sources.scratch import own_folder
from . import catalog as c
from .catalog import query

# ---------------------------------------------------------------- three views

_TEXTS = {"nm": "name_core", "ad": "addr_n", "full": "name_core || ' | ' || addr_n"}


def _view(v: str) -> str:
    """CTEs of one view, over prep: its weights, similarities and ranks."""
    return f"""words_{v} AS (SELECT country_n AS grp, entity_id AS id, src, unnest(string_split({_TEXTS[v]}, ' ')) AS w FROM prep),
  sizes_{v} AS (SELECT grp, id, src, ' ' || w || ' ' AS p, unnest(range(2, least(4, len(w) + 2) + 1)) AS n FROM words_{v}),
  tf_{v} AS (SELECT grp, id, src, gram, count(*) AS tf FROM (SELECT grp, id, src, p[i:i + n - 1] AS gram FROM
    (SELECT *, unnest(range(1, len(p) - n + 2)) AS i FROM sizes_{v})) GROUP BY ALL),
  dfs_{v} AS (SELECT grp, gram, count(*) AS df FROM tf_{v} GROUP BY ALL HAVING count(*) >= 2),
  raw_{v} AS (SELECT t.grp, id, src, gram, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS raw FROM tf_{v} t JOIN dfs_{v} USING (grp, gram)
    JOIN (SELECT country_n AS grp, count(*) AS n FROM prep GROUP BY ALL) USING (grp)),
  weights_{v} AS (SELECT grp, id, src, gram, raw / sqrt(sum(raw * raw) OVER (PARTITION BY grp, id)) AS w FROM raw_{v}),
  sims_{v} AS (SELECT a.grp AS country_n, a.id AS id1, b.id AS id2, round(sum(a.w * b.w), 6) AS sim FROM weights_{v} a JOIN weights_{v} b
    ON a.grp = b.grp AND a.gram = b.gram AND a.src = 1 AND b.src > 1 GROUP BY ALL),
  ranked_{v} AS (SELECT *, row_number() OVER (PARTITION BY id2 ORDER BY sim DESC, id1) AS back,
    row_number() OVER (PARTITION BY id1 ORDER BY sim DESC, id2) AS ahead FROM sims_{v})"""


_VIEWS = ",\n  ".join(_view(v) for v in _TEXTS)
_FOUND = " UNION ".join(f"SELECT country_n, id1, id2 FROM ranked_{v} WHERE back <= 5 OR ahead <= 12" for v in _TEXTS)
_S = ", ".join(f"coalesce(sims_{v}.sim, 0) AS s_{v}" for v in _TEXTS)
_JOINS = " ".join(f"LEFT JOIN sims_{v} ON sims_{v}.id1 = u.id1 AND sims_{v}.id2 = u.id2" for v in _TEXTS)
_BLOCKED = f"""{c._PREPARED}, {_VIEWS}, found AS ({_FOUND}), sided AS (SELECT u.country_n, u.id1, u.id2, {_S} FROM found u {_JOINS}),
  pairs AS (SELECT * FROM (SELECT *, s_nm + s_ad + s_full AS combo, row_number() OVER (PARTITION BY id2 ORDER BY s_nm + s_ad + s_full DESC, id1) AS r
    FROM sided) WHERE r <= 8)"""
_STATS = ", ".join(
    f"""b1_{v} AS (SELECT id1, max(sim) AS best1_{v} FROM ranked_{v} WHERE ahead <= 12 GROUP BY ALL),
  b2_{v} AS (SELECT id2, max(sim) FILTER (back = 1) AS best2_{v}, max(sim) FILTER (back = 2) AS second2_{v} FROM ranked_{v} WHERE back <= 5 GROUP BY ALL)"""
    for v in _TEXTS
)


@query("block_three_views", f"WITH {_BLOCKED} SELECT id1, id2, country_n, s_nm, s_ad, s_full FROM pairs")
def block_three_views(spark, d):
    return blocking.block(*c.sides(spark, d)).pairs


def _gaps() -> str:
    out = ["round(combo, 6) AS combo", "n_c2", "n_c1", "len_name1", "len_addr1", "len_name2", "len_addr2", "src3"]
    for v in _TEXTS:
        b1, b2, s2 = (f"coalesce({x}_{v}, 0)" for x in ("best1", "best2", "second2"))
        out += [f"round(s_{v}, 6) AS s_{v}", f"round(s_{v} - {b2}, 6) AS rgap_{v}", f"round({b2} - {s2}, 6) AS rmargin_{v}", f"round(s_{v} - {b1}, 6) AS fgap_{v}"]
    for n, x in [(v, f"s_{v}") for v in _TEXTS] + [("combo", "combo")]:
        out += [
            f"round({x} - max({x}) OVER (PARTITION BY id2), 6) AS g2gap_{n}", f"round({x} - max({x}) OVER (PARTITION BY id1), 6) AS g1gap_{n}",
            f"row_number() OVER (PARTITION BY id2 ORDER BY {x} DESC, id1) AS g2rank_{n}",
        ]
    return ", ".join(out)


_SECOND = """CASE WHEN abs(combo - top) <= 1e-8 + 1e-5 * abs(top) THEN coalesce(two, -1) ELSE top END"""


@query("cheap_features", f"""WITH {_BLOCKED}, {_STATS}, wide AS (SELECT pairs.*, count(*) OVER (PARTITION BY pairs.id2) AS n_c2,
    count(*) OVER (PARTITION BY pairs.id1) AS n_c1, len(a.name_core) AS len_name1, len(a.addr_n) AS len_addr1, len(b.name_core) AS len_name2,
    len(b.addr_n) AS len_addr2, (b.src = 3)::INTEGER AS src3, {", ".join(f"best1_{v}, best2_{v}, second2_{v}" for v in _TEXTS)},
    max(combo) OVER (PARTITION BY pairs.id2) AS top, nth_value(combo, 2) OVER (PARTITION BY pairs.id2 ORDER BY combo DESC, pairs.id1
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS two
    FROM pairs JOIN prep a ON a.entity_id = pairs.id1 JOIN prep b ON b.entity_id = pairs.id2
    {" ".join(f"LEFT JOIN b1_{v} ON b1_{v}.id1 = pairs.id1 LEFT JOIN b2_{v} ON b2_{v}.id2 = pairs.id2" for v in _TEXTS)})
  SELECT id1, id2, {_gaps()}, round(combo - {_SECOND}, 6) AS g2margin_combo FROM wide""")
def cheap_features(spark, d):
    s1, s23 = c.sides(spark, d)
    found = features.cheap_features(blocking.block(s1, s23), s1, s23)
    whole = [n for n in found.columns if n.startswith(("n_c", "len_", "src3", "g2rank_"))]
    names = [n for n in features.feature_columns(found) if n not in whole]
    rounded = [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]
    return found.select("id1", "id2", *rounded, *[F.col(n).cast("long").alias(n) for n in whole])


@query("view_texts", f"""WITH {c._PREPARED} SELECT entity_id, name_core AS nm, addr_n AS ad, {_TEXTS['full']} AS "full",
  len(name_core) AS len_nm, len(addr_n) AS len_ad FROM prep""")
def view_texts(spark, d):
    ready = c.prepare(c.records(spark, d))
    texts = [v.text.alias(v.name) for v in blocking.default_views()]
    return ready.select("entity_id", *texts, F.length("name_core").cast("long").alias("len_nm"), F.length("addr_n").cast("long").alias("len_ad"))


# ---------------------------------------------------------------- token and number features

#: Pairs of one country and first core word. Some addresses are emptied or lose their numbers, so that sides are missing.
_PLACED = f"""{c._PREPARED}, placed AS (SELECT entity_id AS id, src, country_n, name_n AS name, name_core AS core, string_split(name_core, ' ')[1] AS lead,
  CASE WHEN entity_id LIKE '%7' THEN '' WHEN entity_id LIKE '%3' THEN trim(regexp_replace(regexp_replace(addr_n, '\\d+', ' ', 'g'), '\\s+', ' ', 'g'))
    ELSE addr_n END AS addr FROM prep),
  duo AS (SELECT a.id AS id1, b.id AS id2, a.name AS name_a, b.name AS name_b, a.core AS core_a, b.core AS core_b, a.addr AS addr_a, b.addr AS addr_b
    FROM placed a JOIN placed b ON a.src = 1 AND b.src > 1 AND a.country_n = b.country_n AND a.lead = b.lead),
  parts AS (SELECT *, {", ".join(f"{c._words(f'core_{s}')} AS t_{s}, {c._words(f'addr_{s}')} AS w_{s}, list_distinct(regexp_extract_all(addr_{s}, '[0-9]+')) AS n_{s}, regexp_extract(addr_{s}, '[0-9]+') AS f_{s}, regexp_replace(addr_{s}, '[^0-9]', '', 'g') AS d_{s}" for s in "ab")} FROM duo)"""


def _jaccard(x: str) -> str:
    return f"coalesce(len(list_intersect({x}_a, {x}_b))::DOUBLE / nullif(len(list_distinct(list_concat({x}_a, {x}_b))), 0), 0)"


def _overlap(x: str) -> str:
    return f"coalesce(len(list_intersect({x}_a, {x}_b))::DOUBLE / nullif(least(len(list_distinct({x}_a)), len(list_distinct({x}_b))), 0), 0)"


def _known(test: str, value: str, otherwise: str = "-1") -> str:
    return f"CASE WHEN {test} THEN {value} ELSE {otherwise} END"


_ADDR, _NUM, _FIRST = "addr_a <> '' AND addr_b <> ''", "len(n_a) > 0 AND len(n_b) > 0", "f_a <> '' AND f_b <> ''"
_SHORT = "(len(t_{0}) = 1 AND len(t_{1}) > 1 AND t_{0}[1] = array_to_string(list_transform(t_{1}, lambda t: t[1]), ''))"
_NATIVE = {
    "name_eq": "(name_a = name_b)::INTEGER",
    "core_eq": "(core_a = core_b)::INTEGER",
    "core_jac": _jaccard("t"),
    "core_ovl": _overlap("t"),
    "first_eq": "(t_a[1] = t_b[1])::INTEGER",
    "acronym": f"({_SHORT.format('a', 'b')} OR {_SHORT.format('b', 'a')})::INTEGER",
    "addr_jac": _known(_ADDR, _jaccard("w")),
    "addr_ovl": _known(_ADDR, _overlap("w")),
    "num_jac": _known(_NUM, _jaccard("n")),
    "num_ovl": _known(_NUM, _overlap("n")),
    "num_conf": _known(_NUM, "CASE WHEN list_has_any(n_a, n_b) THEN 1 ELSE -1 END", "0"),
    "firstnum_eq": _known(_FIRST, "CASE WHEN f_a = f_b THEN 1 ELSE -1 END", "0"),
    **{
        f"{n}_extra_{s}": f"len(list_filter(list_distinct({x}_{s}), lambda t: NOT list_contains({x}_{o}, t)))"
        for n, x in (("name", "t"), ("addr", "w"), ("num", "n"))
        for s, o in ("ab", "ba")
    },
    "num_sub": _known(_NUM, "(len(list_filter(n_a, lambda x: len(list_filter(n_b, lambda y: contains(x, y) OR contains(y, x))) > 0)) > 0)::INTEGER"),
    "firstnum_sub": _known(_FIRST, "(contains(f_a, f_b) OR contains(f_b, f_a))::INTEGER"),
    "digits_eq": _known("d_a <> '' AND d_b <> ''", "(d_a = d_b)::INTEGER"),
}


def _duo(spark, d, parts) -> DataFrame:
    """Different texts beside each other, with lists of their records and what `parts` makes of each side's texts."""
    ready = c.prepare_once(c.records(spark, d))
    addr = F.when(F.col("entity_id").endswith("7"), F.lit("")).when(F.col("entity_id").endswith("3"), T.address_words(F.col("addr_n"))).otherwise(F.col("addr_n"))
    lead = F.get(S.tokens(F.col("name_core")), F.lit(0))

    def side(s: str) -> DataFrame:
        rows = ready.where("src = 1" if s == "a" else "src > 1").select(
            "entity_id", "country_n", lead.alias("lead"), F.col("name_n").alias(f"name_{s}"), F.col("name_core").alias(f"core_{s}"), addr.alias(f"addr_{s}")
        )
        return members.lists_of(rows, "country_n", "lead", f"name_{s}", f"core_{s}", f"addr_{s}").withColumns(parts(s))

    return members.beside(side("a"), side("b"), ["country_n", "lead"])


@query("pair_features", f"WITH {_PLACED} SELECT id1, id2, " + ", ".join(f"round(({x})::DOUBLE, 6) AS {n}" for n, x in _NATIVE.items()) + " FROM parts")
def pair_features(spark, d):
    """All token and number features that need no Python, with some sides missing."""
    texts = _duo(spark, d, features.side_parts)
    return members.each_pair(texts.select("_ids1", "_ids2", *[F.round(x.cast("double"), 6).alias(n) for n, x in features.native_features(True).items()]))


@query("jaro_winkler_features", f"""WITH {_PLACED} SELECT id1, id2, {_known(_FIRST, "round(jaro_winkler_similarity(f_a, f_b), 6)")} AS firstnum_jw,
  {_known("d_a <> '' AND d_b <> ''", "round(jaro_winkler_similarity(d_a, d_b), 6)")} AS digits_jw,
  round(jaro_winkler_similarity(replace(core_a, ' ', ''), replace(core_b, ' ', '')), 6) AS nospace_jw FROM parts""")
def jaro_winkler_features(spark, d):
    """The Jaro-Winkler features with the second kernel (gated, whole transpositions), which SQL has too."""
    jw = S.pairwise(S.scorers("gated")["jaro_winkler"])

    def parts(s: str) -> dict[str, Column]:
        addr = F.col(f"addr_{s}")
        return {f"first_{s}": T.first_number(addr), f"dig_{s}": T.digits(addr), f"bare_{s}": F.replace(F.col(f"core_{s}"), F.lit(" "), F.lit(""))}

    first, dig, bare = ([F.col(f"{n}_{s}") for s in "ab"] for n in ("first", "dig", "bare"))
    known = lambda x: F.when((x[0] != "") & (x[1] != ""), F.round(jw(*x), 6)).otherwise(F.lit(-1.0))
    scores = [known(first).alias("firstnum_jw"), known(dig).alias("digits_jw"), F.round(jw(*bare), 6).alias("nospace_jw")]
    return members.each_pair(_duo(spark, d, parts).select("_ids1", "_ids2", *scores))


@query("has_indic", "SELECT doc_id, regexp_matches(text, '[\\x{0900}-\\x{0DFF}]') AS indic FROM documents")
def has_indic(spark, d):
    return c._table(spark, d, "documents").select("doc_id", T.has_indic_col(F.col("text")).alias("indic"))


@query("stack_features", f"""WITH {c._SCORED}, w AS (SELECT *, max(p) OVER (PARTITION BY id2) AS top, nth_value(p, 2) OVER (PARTITION BY id2 ORDER BY p DESC, id1
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS two FROM scored)
  SELECT id1, id2, round(p - top, 6) AS p1_g2gap, row_number() OVER (PARTITION BY id2 ORDER BY p DESC, id1) AS p1_g2rank,
  round(p - CASE WHEN abs(p - top) <= 1e-8 + 1e-5 * abs(top) THEN coalesce(two, -1) ELSE top END, 6) AS p1_g2margin,
  round(p - max(p) OVER (PARTITION BY id1), 6) AS p1_g1gap FROM w""")
def stack_features(spark, d):
    got = features.stack_features(c.scored(spark, d).withColumnRenamed("p", "p1"))
    r = lambda n: F.round(F.col(n).cast("double"), 6).alias(n)
    return got.select("id1", "id2", r("p1_g2gap"), F.col("p1_g2rank").cast("long").alias("p1_g2rank"), r("p1_g2margin"), r("p1_g1gap"))


# ---------------------------------------------------------------- decisions and samples


@query("expected_f_decode", f"""WITH {c._SCORED}, cand AS (SELECT id2 AS id1, id1 AS id2, p, row_number() OVER (PARTITION BY id2 ORDER BY p DESC, id1) AS r,
    count(*) OVER (PARTITION BY id2) AS n FROM scored WHERE p >= 0.02),
  worlds AS (SELECT id1, o, product(CASE WHEN (o // (2 ** (r - 1))::BIGINT) % 2 = 1 THEN p ELSE 1 - p END) AS chance, list((o // (2 ** (r - 1))::BIGINT) % 2 ORDER BY r) AS hit
    FROM cand, unnest(range(0, (2 ** n)::BIGINT)) u(o) GROUP BY id1, o),
  cuts AS (SELECT id1, k, sum(chance * CASE WHEN k = 0 THEN (list_sum(hit) = 0)::INTEGER WHEN list_sum(hit[1:k]) = 0 THEN 0
    ELSE 1.25 * list_sum(hit[1:k]) / (0.25 * list_sum(hit) + k) END) AS f FROM worlds, unnest(range(0, least(6, len(hit)) + 1)) u(k) GROUP BY id1, k),
  best AS (SELECT id1, k FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY round(f, 12) DESC, k) AS r FROM cuts) WHERE r = 1)
  SELECT id1, id2, p FROM cand JOIN best USING (id1) WHERE r <= k""")
def expected_f_decode(spark, d):
    """An order's suppliers, at most seven: SQL goes through all that could be true."""
    flipped = c.scored(spark, d).select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), "p")
    return decode.decode_expected_f(flipped)


@query("subsample", f"""WITH {c._LINKS}, s AS (SELECT s_suppkey AS entity_id FROM supplier WHERE s_suppkey % 10 < 3)
  SELECT 1 AS side, entity_id FROM s UNION ALL SELECT DISTINCT 2, id2 FROM links JOIN s ON id1 = entity_id JOIN orders ON o_orderkey = id2
  UNION ALL SELECT 2, o_orderkey FROM orders WHERE o_orderkey % 10 < 3 AND o_orderkey NOT IN (SELECT id2 FROM links)""")
def subsample(spark, d):
    s1 = c.ids(spark, d).withColumnRenamed("id1", "entity_id")
    s23 = c._table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"))
    a, b = sampling.subsample(s1, s23, c.links(spark, d), 0.3, draw=lambda key, share, seed: F.pmod(key, F.lit(10)) < share * 10)
    return a.select(F.lit(1).alias("side"), "entity_id").unionByName(b.select(F.lit(2).alias("side"), "entity_id"))


_POINTS = ", ".join(f"({t})" for t in evaluate.CURVE)


@query("threshold_curve", f"""WITH {c._SCORED}, {c._LINKS}, {c._IDS}, {c._BEST}, grid(t) AS (SELECT t::DOUBLE FROM (VALUES {_POINTS}) v(t)),
  hits AS (SELECT best.*, (links.id1 IS NOT NULL)::INTEGER AS hit FROM best LEFT JOIN links USING (id1, id2)),
  counts AS (SELECT t, id1, count(*) AS n, sum(hit) AS h FROM hits JOIN grid ON p >= t GROUP BY ALL),
  truth AS (SELECT id1, count(DISTINCT id2) AS n_true FROM links GROUP BY ALL),
  each AS (SELECT grid.t, coalesce(n, 0) AS n, coalesce(h, 0) AS h, coalesce(n_true, 0) AS n_true FROM grid CROSS JOIN ids
    LEFT JOIN counts ON counts.t = grid.t AND counts.id1 = ids.id1 LEFT JOIN truth ON truth.id1 = ids.id1)
  SELECT t, round(avg(CASE WHEN n = 0 AND n_true = 0 THEN 1.0 WHEN h = 0 THEN 0.0 ELSE 1.25 * h / (0.25 * n_true + n) END::DOUBLE), 9) AS f FROM each GROUP BY ALL""")
def threshold_curve(spark, d):
    got = evaluate.threshold_grid(c.scored(spark, d), c.links(spark, d), c.ids(spark, d), evaluate.CURVE, (0.0,))
    return got.select("t", F.round("f", 9).alias("f"))


@query("ceiling", f"""WITH {c._SCORED}, {c._LINKS}, {c._IDS}, hit AS (SELECT id1, count(*) AS h FROM scored JOIN links USING (id1, id2) GROUP BY ALL),
  truth AS (SELECT id1, count(DISTINCT id2) AS n FROM links GROUP BY ALL) SELECT id1, round(CASE WHEN n IS NULL THEN 1 WHEN h IS NULL THEN 0
  ELSE 1.25 * h / (0.25 * n + h) END::DOUBLE, 9) AS f FROM ids LEFT JOIN hit USING (id1) LEFT JOIN truth USING (id1)""")
def ceiling(spark, d):
    """What a perfect choice among the candidates would score."""
    kept = sampling.label(c.scored(spark, d), c.links(spark, d)).where("y = 1")
    return evaluate.entity_scores(c.ids(spark, d), kept, c.links(spark, d)).select("id1", F.round("f", 9).alias("f"))


@query("recall_by_view", f"""WITH {_BLOCKED}, truth AS (SELECT a.entity_id AS id1, b.entity_id AS id2 FROM prep a JOIN prep b
    ON a.src = 1 AND b.src > 1 AND a.country_n = b.country_n AND a.name_n = b.name_n),
  {", ".join(f"r_{n} AS (SELECT id1, id2, row_number() OVER (PARTITION BY id2 ORDER BY {x} DESC, id1) AS r FROM pairs)" for n, x in [*((v, f"s_{v}") for v in _TEXTS), ("combo", "combo")])},
  ks AS (SELECT unnest([1, 2, 3, 5, 10, 20]) AS k)
  {" UNION ALL ".join(f"SELECT '{n}' AS view, k, round((SELECT count(*) FROM truth JOIN r_{n} USING (id1, id2) WHERE r <= k)::DOUBLE / (SELECT count(*) FROM truth), 9) AS recall FROM ks" for n in [*_TEXTS, "combo"])}""")
def recall_by_view(spark, d):
    s1, s23 = c.sides(spark, d)
    marked, n_links = blocking.equal_links(blocking.block(s1, s23).pairs, s1, s23, ["country_n", "name_n"])
    got = evaluate.recall_of_marked(marked, n_links, features.VIEWS)
    return got.withColumn("recall", F.round("recall", 9))


# ---------------------------------------------------------------- reports


@query("describe_scores", f"""WITH {c._SCORED} SELECT count(p) AS n, round(avg(p), 9) AS mean, round(stddev_samp(p), 9) AS sd, min(p) AS least,
  round(quantile_cont(p, 0.25), 9) AS q25, round(quantile_cont(p, 0.5), 9) AS q50, round(quantile_cont(p, 0.75), 9) AS q75, max(p) AS most FROM scored""")
def describe_scores(spark, d):
    got = diagnostics.describe(c.scored(spark, d), "p")
    return got.select("n", *[F.round(x, 9).alias(x) for x in ("mean", "sd")], "least", *[F.round(x, 9).alias(x) for x in ("q25", "q50", "q75")], "most")


@query("value_counts", "SELECT source, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM documents GROUP BY source")
def value_counts(spark, d):
    return diagnostics.value_counts(c._table(spark, d, "documents"), "source")


@query("crosstab", """SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es,
  count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source""")
def crosstab(spark, d):
    return diagnostics.crosstab(c._table(spark, d, "documents"), "source", "lang", ["de", "en", "es", "fr"])


@query("unlike_token_swaps", f"""WITH {c._PAIRS}, s AS (SELECT list_filter(list_distinct({c._TOK['a']}), lambda t: NOT list_contains({c._TOK['b']}, t)) AS x,
  list_filter(list_distinct({c._TOK['b']}), lambda t: NOT list_contains({c._TOK['a']}, t)) AS y FROM pairs),
  swaps AS (SELECT least(x[1], y[1]) AS token_1, greatest(x[1], y[1]) AS token_2, count(*) AS n FROM s WHERE len(x) = 1 AND len(y) = 1 GROUP BY ALL HAVING count(*) >= 3)
  SELECT * FROM swaps WHERE jaro_winkler_similarity(token_1, token_2) < 0.85""")
def unlike_token_swaps(spark, d):
    """Swapped tokens that aren't spellings of each other: candidates for aliases."""
    return diagnostics.token_swaps(c._counted(spark, d), "core_a", "core_b", unlike=0.85, kernel=S.scorers("gated")["jaro_winkler"])


# ---------------------------------------------------------------- files


@query("tsv_files", f"""WITH {c._REC} SELECT entity_id, src::INTEGER AS src, business_name, CASE WHEN src = 3 THEN '' ELSE business_address END AS business_address, country FROM rec""")
def tsv_files(spark, d):
    """The records written as the three files of a split, the third without its address column, and read again."""
    rows, folder = c.records(spark, d), own_folder(spark, "split")
    for n in (1, 2, 3):
        part = rows.where(F.col("src") == n).drop("src", *(["business_address"] if n == 3 else []))
        tables.write_tsv(part, f"{folder}/train/train_source{n}.tsv")
    s1, s23 = tables.read_split(spark, folder, "train")
    return s1.drop("ordinal").unionByName(s23).select("entity_id", "src", "business_name", "business_address", "country")


@query("link_files", f"""WITH {c._LINKS}, {c._IDS} SELECT 'S1-' || ids.id1 AS id1, CASE WHEN id2 IS NOT NULL THEN 'S2-' || id2 END AS id2 FROM ids LEFT JOIN links USING (id1)""")
def link_files(spark, d):
    """Links written as a file of lists, in several parts, and read again; ids without a link have a null."""
    rows = c.links(spark, d).select(F.concat(F.lit("S1-"), "id1").alias("id1"), F.concat(F.lit("S2-"), "id2").alias("id2"))
    s1 = c.ids(spark, d).select(F.concat(F.lit("S1-"), "id1").alias("entity_id"), F.col("id1").alias("ordinal"))
    folder = own_folder(spark, "links")
    tables.write_results(s1, rows, rows, folder)
    found, every = tables.read_links(spark, f"{folder}/matching_results.tsv")
    return every.join(found, "id1", "left").select("id1", "id2")


@query("result_files", f"""WITH {c._SCORED}, {c._BEST}, l AS (SELECT id1, string_agg(DISTINCT id2::VARCHAR, ',' ORDER BY id2::VARCHAR) AS ids FROM best
  WHERE p >= 0.5 GROUP BY ALL) SELECT s_suppkey || chr(9) || coalesce(ids, '') AS line FROM supplier LEFT JOIN l ON id1 = s_suppkey""")
def result_files(spark, d):
    """The lines of a written result, its header left out."""
    s1 = c.ids(spark, d).select(F.col("id1").alias("entity_id"), F.col("id1").alias("ordinal"))
    pairs = c.scored(spark, d)
    texts = lambda rows: rows.select("id1", F.col("id2").cast("string").alias("id2"))
    folder = own_folder(spark, "results")
    tables.write_results(s1, texts(pairs), texts(decode.decode(pairs, 0.5)), folder)
    return tables.read_lines(spark, f"{folder}/matching_results.tsv")[1].select(F.col("value").alias("line"))


@query("probability_files", f"WITH {c._SCORED} SELECT id1, id2, round(p, 6) AS p FROM scored")
def probability_files(spark, d):
    folder = own_folder(spark, "probabilities")
    tables.write_probabilities(c.scored(spark, d), folder)
    back = tables.read_tsv(spark, folder)
    return back.select(F.col("id1").cast("long").alias("id1"), F.col("id2").cast("long").alias("id2"), F.round(F.col("p").cast("double"), 6).alias("p"))


@query("id_files", "SELECT DISTINCT trim(s) AS id1 FROM (SELECT ' ' || c_mktsegment AS s FROM customer) WHERE trim(s) <> ''")
def id_files(spark, d):
    """The first column of a file, trimmed, without repeats."""
    folder = own_folder(spark, "ids")
    tables.write_tsv(c._table(spark, d, "customer").select(F.concat(F.lit(" "), "c_mktsegment").alias("name"), "c_custkey"), folder)
    return tables.read_ids(spark, folder)


# ---------------------------------------------------------------- transliteration

_FROM, _TO = "abdghijklmnoprstuv", "अबदगहइजकलमनओपरसतउव"
_CONS = "[bdghjklmnprstv]"


def _romanized(x: str) -> str:
    # A letter that ends one match can't begin the next: twice, and marked, so that a vowel put in isn't taken for a letter.
    low = f"lower({x})"
    once = rf"regexp_replace({low}, '({_CONS})([{_FROM}])', '\1' || chr(1) || '\2', 'g')"
    twice = rf"regexp_replace({once}, '({_CONS})([{_FROM}])', '\1' || chr(1) || '\2', 'g')"
    words = c._words(rf"regexp_replace(replace({twice}, chr(1), 'a'), '\s+', ' ', 'g')")
    return f"CASE WHEN regexp_matches({low}, '[{_FROM}]') THEN array_to_string({c._mapped(words, vocab.LOAN_WORDS)}, ' ') ELSE {low} END"


@query("romanize", f"SELECT doc_id, {_romanized('text')} AS romanized FROM documents")
def romanize(spark, d):
    """Each document's whole text in a Brahmic alphabet (letters by place), romanised."""
    docs = c._table(spark, d, "documents")
    return docs.select("doc_id", T.romanize_col(F.translate(F.lower("text"), _FROM, _TO)).alias("romanized"))


@query("group_keys", f"""WITH {c._SCORED} SELECT id1, id2, max(p) OVER (PARTITION BY id1) AS top, count(*) OVER (PARTITION BY id1) AS size FROM scored""")
def group_keys(spark, d):
    """Group statistics by the other side's key."""
    rows = c.scored(spark, d)
    return rows.select("id1", "id2", windows.group_max(F.col("p"), "id1").alias("top"), windows.group_size("id1").alias("size"))
