"""Command line: `python -m kindred.plans.cli run ...`, `... validate ...` and `... aliases ...`."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ..operators import diagnostics
from ..operators import validate as rules
from ..operators.model import Trees
from ..sources import tables
from .config import LinkConfig
from .linker import Linker, prepare, save


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    cfg = LinkConfig(
        scale=args.k_scale, keep=args.keep, keep_second=args.keep_second, share=args.frac, touch_rank=args.touch_rank,
        countries=tuple(c for c in args.train_countries.split(",") if c), folds_second=args.folds,
        trees=Trees(rounds=args.rounds), seed=args.seed, encoder=args.encoder, dim=args.dim, scorers=args.backend, cache=args.cache,
    )

    def load(split: str):
        parts = [prepare(x) for x in tables.read_split(spark, args.data, split)]
        if not args.cache:
            return parts
        return [tables.cached(p, f"{args.cache}/{split}_{n}_{cfg.key(args.data, split)}") for n, p in zip(("s1", "s23"), parts)]

    s1, s23 = load("train")
    links, _ = tables.read_links(spark, f"{args.data}/train/train_ground_truth.tsv")
    linker = Linker(cfg)
    fitted = linker.fit(s1, s23, links)
    save(fitted, f"{args.out}/model")
    print(tables.summary_text(fitted.report))
    if args.holdout and (table := linker.hold_out(fitted, s1, links)) is not None:
        table.show(truncate=False)
    if not args.no_test:
        t1, t23 = load("test")
        candidates, matches = linker.transform(fitted, t1, t23)
        tables.write_results(t1, candidates, matches, args.out)
        tables.write_probabilities(candidates, f"{args.out}/pair_probabilities.tsv")
    return 0


def check(spark: SparkSession, args: argparse.Namespace) -> int:
    required = tables.read_ids(spark, f"{args.test_dir}/test_source1.tsv")
    valid, extra = None, []
    if args.check_ids or args.strict:
        paths = [f"{args.test_dir}/test_source{n}.tsv" for n in (2, 3)]
        extra = [f"{p} not found: whether ids exist can't be checked" for p in paths if not tables.exists(spark, p)]
        if not extra:
            both = [tables.read_ids(spark, p, "id2") for p in paths]
            valid = both[0].union(both[1])
    files, broken = [], []
    for p in (args.matching, args.candidate):
        there = p and tables.exists(spark, p)
        if there and (n := tables.count_not_utf8(spark, p)):
            broken.append(f"{p}: {n} lines are not UTF-8 text")
        files.append(tables.read_lines(spark, p) if there else None)
    errors, warnings = rules.validate(*files, required, valid, args.strict)
    for name, found in (("ERROR", broken + errors), ("WARNING", extra + warnings)):
        for x in found:
            print(f"{name}: {x}")
    return int(bool(broken + errors))


def aliases(spark: SparkSession, args: argparse.Namespace) -> int:
    """Words that stand for each other in linked names and aren't spellings of one another, as JSON lines."""
    s1, s23 = (prepare(x) for x in tables.read_split(spark, args.data, "train"))
    links, _ = tables.read_links(spark, f"{args.data}/train/train_ground_truth.tsv")
    pairs = diagnostics.side_by_side(links, s1, s23, ("name_core",))
    tables.write_json(diagnostics.token_swaps(pairs, "name_core_1", "name_core_2", args.least, unlike=0.85), args.out)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kindred")
    commands = top.add_subparsers(dest="command", required=True)
    r = commands.add_parser("run", help="train, report and link the test split")
    r.add_argument("--data", required=True)
    r.add_argument("--out", default="output")
    r.add_argument("--cache", default="")
    r.add_argument("--frac", type=float, default=0.1)
    r.add_argument("--train-countries", default="")
    r.add_argument("--no-test", action="store_true")
    r.add_argument("--holdout", action="store_true")
    r.add_argument("--k-scale", type=float, default=1.0)
    r.add_argument("--keep", type=int, default=8)
    r.add_argument("--keep-second", type=int, default=3)
    r.add_argument("--touch-rank", type=int, default=3)
    r.add_argument("--folds", type=int, default=4)
    r.add_argument("--rounds", type=int, default=Trees().rounds)
    r.add_argument("--encoder", default="exact", help="exact, rp, svd or st:<model>")
    r.add_argument("--dim", type=int, default=256)
    r.add_argument("--backend", choices=("plain", "gated"), default="plain", help="string kernels")
    r.add_argument("--seed", type=int, default=0)
    v = commands.add_parser("validate", help="check result files")
    v.add_argument("--matching", required=True)
    v.add_argument("--candidate", default="")
    v.add_argument("--test-dir", required=True)
    v.add_argument("--check-ids", action="store_true")
    v.add_argument("--strict", action="store_true")
    a = commands.add_parser("aliases", help="words that stand for each other in linked names")
    a.add_argument("--data", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--least", type=int, default=3)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("kindred").getOrCreate()
    return {"run": run, "validate": check, "aliases": aliases}[args.command](spark, args)


if __name__ == "__main__":
    sys.exit(main())
