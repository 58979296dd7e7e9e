import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import blocking, decode, diagnostics, evaluate, features, knn, model, sampling, validate, vectors, windows
from kindred.plans import linker
from kindred.plans.config import LinkConfig
from kindred.sources import synth, tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


PAIRS = "id1 long, id2 long, p double"


def test_windows(spark):
    df = frame(spark, [(1, 1, 0.9), (2, 1, 0.5), (1, 2, 0.7), (3, 3, 0.9), (4, 3, 0.9)], PAIRS)
    p = F.col("p")
    got = df.select(
        "id2", "id1", windows.group_max(p, "id2"), windows.group_size("id2"), windows.group_rank(p, "id2", "id1"), windows.group_second(p, "id2", "id1")
    ).orderBy("id2", "id1")
    assert [tuple(r)[2:] for r in got.collect()] == [(0.9, 2, 1, 0.5), (0.9, 2, 2, 0.9), (0.7, 1, 1, -1.0), (0.9, 2, 1, 0.9), (0.9, 2, 2, 0.9)]
    assert windows.top_rows(df, "p", "id2", "id1", 1).count() == 3


def test_decode(spark):
    df = frame(spark, [(1, 10, 0.9), (2, 10, 0.85), (1, 11, 0.4), (1, 12, 0.6)], PAIRS)
    ids = lambda x: sorted((r.id1, r.id2) for r in x.collect())
    assert ids(decode.decode(df, 0.5)) == [(1, 10), (1, 12)]
    assert ids(decode.decode(df, 0.5, 0.2)) == [(1, 12)]
    assert ids(decode.one_to_one(df)) == [(1, 10), (1, 11), (1, 12)]
    assert ids(decode.decode_threshold(df, 0.6)) == [(1, 10), (1, 12), (2, 10)]


def test_expected_f_is_exact():
    p = np.array([0.9, 0.6, 0.2])
    for k in range(4):
        want = 0.0
        for outcome in itertools.product([0, 1], repeat=3):
            chance = np.prod(np.where(outcome, p, 1 - p))
            hits, true = sum(outcome[:k]), sum(outcome)
            want += chance * (float(true == 0) if k == 0 else (1.25 * hits / (0.25 * true + k) if hits else 0.0))
        assert decode.expected_f(p, 3)[k] == pytest.approx(want)


def test_expected_f_decode(spark):
    df = frame(spark, [(1, 10, 0.95), (1, 11, 0.9), (1, 12, 0.05), (2, 13, 0.1)], PAIRS)
    assert sorted((r.id1, r.id2) for r in decode.decode_expected_f(df).collect()) == [(1, 10), (1, 11)]
    assert decode.decode_expected_f(df.where("false")).count() == 0


def test_scores(spark):
    ids = frame(spark, [(i,) for i in range(1, 7)], "id1 long")
    pred = frame(spark, [(2, 1), (4, 1), (5, 1), (5, 2), (5, 3), (6, 9)], "id1 long, id2 long")
    true = frame(spark, [(3, 1), (4, 1), (4, 2), (5, 1), (5, 3), (6, 1)], "id1 long, id2 long")
    scores = evaluate.entity_scores(ids, pred, true)
    got = {r.id1: r.f for r in scores.collect()}
    assert got == pytest.approx({1: 1, 2: 0, 3: 0, 4: 0.8333333, 5: 0.7142857, 6: 0})
    row = evaluate.macro_f(scores).first()
    assert (row.n_single, row.n_match) == (2, 4) and row.singletons == 0.5


def test_threshold_grid_equals_decoding(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b), float(p)) for a, b, p in zip(rng.integers(1, 9, 80), rng.integers(1, 30, 80), rng.random(80).round(3))]
    df = frame(spark, rows, PAIRS).groupBy("id1", "id2").agg(F.max("p").alias("p"))
    true = frame(spark, [(i % 8 + 1, i) for i in range(1, 25)], "id1 long, id2 long")
    ids = frame(spark, [(i,) for i in range(1, 12)], "id1 long")
    grid = {(r.t, r.margin): r.f for r in evaluate.threshold_grid(df, true, ids).collect()}
    assert len(grid) == 45
    for t, m in [(0.2, 0.0), (0.5, 0.1), (0.8, 0.2)]:
        direct = evaluate.macro_f(evaluate.entity_scores(ids, decode.decode(df, t, m), true)).first()["all"]
        assert grid[t, m] == pytest.approx(direct)
    flat = frame(spark, [(0.3, 0.1, 0.5), (0.2, 0.2, 0.5), (0.2, 0.1, 0.5)], "t double, margin double, f double")
    assert evaluate.best_setting(flat) == (0.2, 0.1)


def test_char_ngrams(spark):
    row = frame(spark, [("ring",)], "x string").select(vectors.char_ngrams(F.col("x"))).first()[0]
    assert row == [" r", "ri", "in", "ng", "g ", " ri", "rin", "ing", "ng ", " rin", "ring", "ing "]
    one = frame(spark, [("a",), ("",)], "x string").select(vectors.char_ngrams(F.col("x"))).collect()
    assert one[0][0] == [" a", "a ", " a "] and one[1][0] == []


def _brute_topk(a, b, k):
    return {i: sorted(b, key=lambda j: (-round(float(np.dot(a[i], b[j])), 6), j))[:k] for i in a}


def test_dense_topk_in_several_blocks(spark):
    rng = np.random.default_rng(2)
    v = {i: rng.standard_normal(5) for i in range(60)}
    df = frame(spark, [(i, 0, x.tolist()) for i, x in v.items()], "id long, grp int, vector array<double>")
    got = {}
    for r in knn.dense_topk(df, df, 3, rows=17).orderBy("id1", F.desc("sim"), "id2").collect():
        got.setdefault(r.id1, []).append(r.id2)
    assert got == _brute_topk(v, v, 3)


def test_sparse_topk(spark):
    texts = frame(spark, [(1, "x", "alpha beta"), (2, "x", "alpha beta"), (3, "x", "gamma delta"), (4, "y", "alpha beta")], "id long, grp string, text string")
    w = vectors.tfidf(texts)
    norms = w.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()
    assert all(r.n == pytest.approx(1) for r in norms)
    got = knn.sparse_topk(w, w, 2).collect()
    assert {(r.id1, r.id2) for r in got if r.sim > 0.99} >= {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert all((r.id1 == 4) == (r.id2 == 4) for r in got)


def test_encoders(spark):
    texts = frame(spark, [(i, "x", t) for i, t in enumerate(["alpha beta", "alpha beta", "gamma delta", "alpha gamma"])], "id long, grp string, text string")
    w = vectors.tfidf(texts)
    for name, arg in (("rp", {"dim": 128}), ("svd", {"dim": 3, "buckets": 64})):
        rows = {r.id: np.array(r.vector) for r in vectors.encoder(name)(w, **arg).collect()}
        assert np.allclose(rows[0], rows[1], atol=1e-6) and np.linalg.norm(rows[2]) == pytest.approx(1, abs=1e-5)
        assert rows[0] @ rows[1] > rows[0] @ rows[2]
    with pytest.raises(ValueError):
        vectors.encoder("st:unknown")


RECORDS = "entity_id string, business_name string, business_address string, country string, src int"


def test_blocking_stays_in_the_country(spark):
    rows = [("S1-1", "Alpha Beta", "1 Main Street", "US", 1), ("S1-2", "Gamma", "2 Oak", "India", 1), ("S1-3", "", "", "US", 1)]
    other = [("S2-1", "Alpha Beta Inc", "1 Main St", "US", 2), ("S2-2", "Alpha Beta", "1 Main St", "France", 2), ("S3-1", "Gama", "2 Oak", "India", 3)]
    s1, s23 = linker.prepare(frame(spark, rows, RECORDS)), linker.prepare(frame(spark, other, RECORDS))
    got = blocking.block(s1, s23)
    assert {(r.id1, r.id2) for r in got.pairs.collect()} == {("S1-1", "S2-1"), ("S1-2", "S3-1"), ("S1-3", "S2-1")}  # the last by its bar alone
    stats = {r.id2: r.best2_nm for r in got.s23_stats.collect()}
    assert stats["S2-2"] == 0 and stats["S2-1"] > 0.9


def test_native_features(spark):
    rows = [("1", "2", "abc private", "abc", "abc", "abc", "70 main st", "709 main st 4"), ("1", "3", "sm", "sarah marketing", "sm", "sarah marketing", "", "5 x")]
    names = ("id1", "id2", "name_a", "name_b", "core_a", "core_b", "addr_a", "addr_b")
    got = frame(spark, rows, ", ".join(f"{n} string" for n in names)).select(*[c.alias(k) for k, c in features.native_features().items()]).collect()
    a, b = got[0].asDict(), got[1].asDict()
    assert (a["core_eq"], a["name_eq"], a["first_eq"], a["num_conf"], a["num_sub"], a["firstnum_sub"], a["firstnum_eq"]) == (1, 0, 1, -1, 1, 1, -1)
    assert (b["acronym"], b["addr_jac"], b["num_conf"], b["num_jac"], b["digits_eq"]) == (1, -1, 0, -1, -1)
    assert features.fuzzy("abc", "abc", "", "5 x")[1:4] == (-1.0, -1.0, -1.0)


def test_sampling(spark):
    s1 = frame(spark, [(i,) for i in range(200)], "entity_id long")
    s23 = frame(spark, [(i,) for i in range(1000, 1400)], "entity_id long")
    links = frame(spark, [(i % 200, 1000 + i) for i in range(300)], "id1 long, id2 long")
    a, b = sampling.subsample(s1, s23, links, 0.3)
    kept = {r[0] for r in a.collect()}
    got = {r[0] for r in b.collect()}
    assert 30 < len(kept) < 90
    assert {1000 + i for i in range(300) if i % 200 in kept} == {x for x in got if x < 1300}
    own = {r.id2: r.owner for r in sampling.owners(s1, s23, links).collect()}
    assert own[1000] == 0 and own[1399] is None


def test_tables_round_trip(spark, tmp_path):
    s1, s23, links = synth.generate(spark, 20)
    synth.write(s1, s23, links, str(tmp_path), "train")
    a, b = tables.read_split(spark, str(tmp_path), "train")
    assert a.count() == s1.count() and b.count() == s23.count()
    assert sorted(map(tuple, b.select("entity_id", "business_name").collect())) == sorted(map(tuple, s23.select("entity_id", "business_name").collect()))
    read, ids = tables.read_links(spark, f"{tmp_path}/train/train_ground_truth.tsv")
    assert set(map(tuple, read.collect())) == set(map(tuple, links.collect())) and ids.count() == s1.count()
    pairs = links.withColumn("p", F.lit(1.0))
    tables.write_results(s1, pairs, pairs, f"{tmp_path}/out")
    head, lines = tables.read_lines(spark, f"{tmp_path}/out/matching_results.tsv")
    required = s1.select(F.col("entity_id").alias("id1"))
    errors, warnings = validate.validate((head, lines), (head.replace("matched", "candidate"), lines), required)
    assert errors == [] and len(warnings) == 1
    with pytest.raises(ValueError):
        tables.write_results(s1, pairs.where("false"), pairs, f"{tmp_path}/bad")


@pytest.mark.parametrize(
    "lines, broken",
    [
        (["S1-1\tS2-1,S3-1", "S1-2\t"], set()),
        (["S1-1\t"], {"missing"}),
        (["S1-1\t", "S1-1\t", "S1-2\t"], {"duplicate_row"}),
        (["S1-1\tS2-1,S2-1", "S1-2\t"], {"repeated_id"}),
        (["S1-1\tS1-2", "S1-2\t"], {"self_match"}),
        (["S1-1\tX-9", "S1-2\t"], {"wrong_prefix"}),
        (["S1-1\tS2-1,,S3-1", "S1-2\t"], {"wrong_prefix"}),
        (["S1-1\t", "S1-2\t", "S1-9\t"], {"unknown_row"}),
        (["S1-1", "S1-1\t", "S1-2\t"], {"malformed"}),
        (["S1-1\tS2-7", "S1-2\t"], {"unknown_id"}),
    ],
)
def test_validator(spark, lines, broken):
    rows = validate.parse(frame(spark, [(x,) for x in lines], "value string"))
    required = frame(spark, [("S1-1",), ("S1-2",)], "id1 string")
    valid = frame(spark, [("S2-1",), ("S3-1",)], "id2 string")
    assert {r.rule for r in validate.broken_rules(rows, required, valid).collect()} == broken


def test_headers():
    good = "\t".join(validate.HEADERS["matching"])
    assert validate.header_problem(good, "matching") is None
    assert validate.header_problem(good.upper(), "matching") is None
    assert validate.header_problem(good.upper(), "matching", strict=True)
    assert "comma" in validate.header_problem(good.replace("\t", ","), "matching")
    assert validate.header_problem("", "matching") == "empty file"


def test_reports(spark):
    pairs = frame(spark, [("a x", "a y")] * 3 + [("b", "c")], "a string, b string")
    assert [tuple(r) for r in diagnostics.token_swaps(pairs, "a", "b").collect()] == [("x", "y", 3)]
    df = frame(spark, [("S1-1", "n", " ", "US"), ("S1-1", "", "a", "US"), ("S2-1", "n", "a", "FR")], "entity_id string, business_name string, business_address string, country string")
    row = diagnostics.quality_profile({"S1-": df}).first()
    assert (row.n_rows, row.n_ids, row.n_repeated, row.n_bad_prefix, row.n_countries) == (3, 2, 1, 1, 2)


def test_models(spark):
    rng = np.random.default_rng(0)
    x = rng.random((300, 2))
    rows = [(i % 40, i, float(a), float(b), int(a > 0.5)) for i, (a, b) in enumerate(x)]
    df = frame(spark, rows, "id1 long, id2 long, a double, b double, y int")
    trees = model.Trees(rounds=3, depth=2, step=0.1, least_leaf=5)
    fitted = model.fit(df, ["a", "b"], trees)
    scored = fitted.score(df).collect()
    assert np.mean([(r.p > 0.5) == (r.y == 1) for r in scored]) > 0.95
    assert model.out_of_fold(df, ["a", "b"], 2, trees).count() == 300
    assert model.fit(df.withColumn("y", F.lit(0)), ["a"]).score(df).first().p == 0.0
    assert model.permutation_importance(df, fitted)[0][0] == "a"


def test_chain(spark, tmp_path):
    cfg = LinkConfig(folds_first=2, folds_second=2, trees=model.Trees(rounds=2, depth=3, step=0.1, least_leaf=5), cache=f"{tmp_path}/cache")
    s1, s23, links = synth.generate(spark, 60)
    p1, p23 = linker.prepare(s1), linker.prepare(s23)
    chain = linker.Linker(cfg)
    fitted = chain.fit(p1, p23, links)
    assert fitted.report["all"] > 0.6 and fitted.report["ceiling"] > 0.9
    linker.save(fitted, f"{tmp_path}/model")
    assert spark.read.parquet(f"{tmp_path}/model/out_of_fold").count() == fitted.out_of_fold.count()
    again = linker.load(f"{tmp_path}/model", cfg)
    candidates, matches = chain.transform(again, p1, p23)
    assert matches.join(candidates, ["id1", "id2"], "left_anti").count() == 0
    assert matches.groupBy("id2").count().where("count > 1").count() == 0
    assert cfg.key("a") != LinkConfig().key("a")


def test_folds_are_fitted_at_once(spark, monkeypatch):
    from threading import Barrier

    gate, real = Barrier(3, timeout=60), model.fit
    monkeypatch.setattr(model, "fit", lambda *a: gate.wait() is not None and real(*a))
    df = frame(spark, [(i % 40, i, float(i % 7), int(i % 7 > 3)) for i in range(200)], "id1 long, id2 long, a double, y int")
    trees = model.Trees(rounds=2, depth=2, step=0.1, least_leaf=5)
    scored, whole = model.out_of_fold_and_whole(df, ["a"], 2, trees)
    monkeypatch.undo()
    alone = real(df, ["a"], trees)
    assert [r.p for r in whole.score(df).orderBy("id2").collect()] == [r.p for r in alone.score(df).orderBy("id2").collect()]
    folded = df.withColumn("fold", F.pmod(F.xxhash64("id1"), F.lit(2)))
    first = real(folded.where("fold = 1"), ["a"], trees).score(folded.where("fold = 0"))
    assert scored.count() == 200 and first.join(scored.withColumnRenamed("p", "q"), "id2").where("p <> q").count() == 0


def test_chain_blocks_the_same_records_once(spark, monkeypatch):
    cfg = LinkConfig(folds_first=2, folds_second=2, trees=model.Trees(rounds=2, depth=2, step=0.1, least_leaf=5))
    s1, s23, links = synth.generate(spark, 30)
    p1, p23 = linker.prepare(s1), linker.prepare(s23)
    calls, real = [], blocking.block
    monkeypatch.setattr(blocking, "block", lambda *a, **k: calls.append(1) or real(*a, **k))
    fitted, candidates, matches = linker.Linker(cfg).fit_transform(p1, p23, links)
    assert len(calls) == 1
    again = linker.Linker(cfg).transform(fitted, p1, p23)
    for a, b in zip((candidates, matches), again):
        assert sorted(a.select("id1", "id2").collect()) == sorted(b.select("id1", "id2").collect())


def test_dense_blocking_finds_most_of_the_exact_candidates(spark):
    s1, s23, links = synth.generate(spark, 120)
    p1, p23 = linker.prepare(s1), linker.prepare(s23)
    exact, near = (blocking.block(p1, p23, encoder=e).pairs.select("id1", "id2") for e in ("exact", "rp"))
    assert exact.join(near, ["id1", "id2"]).count() >= 0.95 * exact.count()
    sims = blocking.block(p1, p23, encoder="rp").pairs
    both = sims.join(blocking.block(p1, p23).pairs.select("id1", "id2", F.col("s_nm").alias("s")), ["id1", "id2"])
    assert both.where("abs(s - s_nm) > 1e-6").count() == 0


def test_results_are_one_file_in_order(spark, tmp_path):
    n = 2000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s1 = spark.range(n).select(F.concat(F.lit("S1-"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("entity_id"), (n - F.col("id")).alias("ordinal"))
        pairs = s1.where("ordinal % 3 = 0").select(F.col("entity_id").alias("id1"), F.lit("S2-1").alias("id2"))
        tables.write_results(s1, pairs, pairs, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = open(f"{tmp_path}/matching_results.tsv").read().split("\n")
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and lines[-1] == "" and len(lines) == n + 2
    assert [x.split("\t")[0] for x in lines[1:-1]] == [f"S1-{n - i - 1:05d}" for i in range(n)]
    head, rows = tables.read_lines(spark, f"{tmp_path}/matching_results.tsv")
    assert head == lines[0] and rows.count() == n
    assert tables.count_not_utf8(spark, f"{tmp_path}/matching_results.tsv") == 0
    (tmp_path / "bad.tsv").write_bytes(b"a\tb\nS1-1\t\xff\xfe\n")
    assert tables.count_not_utf8(spark, f"{tmp_path}/bad.tsv") == 1


def test_command_line(spark, tmp_path, capsys):
    import json

    from kindred.plans import cli

    s1, s23, links = synth.generate(spark, 15)
    for split in ("train", "test"):
        synth.write(s1, s23, links, str(tmp_path), split)
    tables.write_results(s1, links, links, f"{tmp_path}/out")
    files = ["--matching", f"{tmp_path}/out/matching_results.tsv", "--candidate", f"{tmp_path}/out/candidate_pairs.tsv"]
    assert cli.main(["validate", *files, "--test-dir", f"{tmp_path}/test", "--check-ids"]) == 0
    assert cli.main(["validate", "--matching", f"{tmp_path}/none.tsv", "--test-dir", f"{tmp_path}/test"]) == 1
    assert "not found" in capsys.readouterr().out
    assert cli.main(["aliases", "--data", str(tmp_path), "--out", f"{tmp_path}/aliases", "--least", "1"]) == 0
    rows = [json.loads(x) for f in (tmp_path / "aliases").glob("part-*") for x in f.read_text().splitlines()]
    assert all({"token_1", "token_2", "n"} <= set(r) for r in rows)


def test_second_kernels():
    from kindred.functions import similarity as S

    assert S.indel_ratio("", "") == 1 and S.indel_ratio("a", "") == 0
    assert S.indel_ratio("abcd", "bcde") == 0.75 == S.indel_ratio("bcde", "abcd")
    gated = S.scorers("gated")
    assert gated["token_set"]("a b", "a b c") == 1 and gated["token_sort"]("b a", "a b") == 1
    assert gated["jaro_winkler"]("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    with pytest.raises(ValueError):
        S.scorers("other")


def test_pair_histograms(spark):
    records = frame(spark, [(f"S{1 + i % 2}-{i // 2}", f"name{i // 2} works") for i in range(400)], "entity_id string, name_core string")
    links = frame(spark, [(f"S1-{i}", f"S2-{i}") for i in range(200)], "id1 string, id2 string")
    got = {(r.kind, r.bin): r.n for r in diagnostics.pair_histograms(links, records).collect()}
    assert got[("true", 19)] == 200 and got.get(("random", 19), 0) < 100


def test_no_silent_folder_on_a_cluster(spark, monkeypatch):
    from kindred.sources import scratch

    class Context:
        applicationId, master = "app", "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})()

    with pytest.raises(ValueError):
        scratch.folder(Session())


def test_stream(spark, tmp_path):
    """A record's match doesn't depend on what arrives with it, and no scratch tables pile up."""
    from kindred.sources import scratch
    from kindred.streaming import incremental

    s1, s23, _ = synth.generate(spark, 30)
    s23.repartition(3).write.parquet(f"{tmp_path}/in")
    p1, schema = linker.prepare(s1), s23.schema.simpleString()[7:-1].replace(":", " ")
    found, left = [], []
    for per_batch in (1, 100):
        marks = scratch.since()
        stream = incremental.record_stream(spark, f"{tmp_path}/in", schema, per_batch=per_batch)
        incremental.link_stream(stream, p1, f"{tmp_path}/out{per_batch}", f"{tmp_path}/check{per_batch}").awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/out{per_batch}").select("id1", "id2", F.round("p", 6).alias("p"))
        found.append(sorted(map(tuple, got.collect())))
        left.append(len(scratch.since() - marks))
    assert found[0] == found[1] and len(found[0]) > 0 and left == [2, 2]
