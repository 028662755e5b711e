"""Command line: evaluate, check, train, inspect, model, corpus, benchmark, harness, init.

Exit codes of evaluate: 0 accepted, 1 warned, 2 rejected, 3 error; of check: 0 passed, 1 rejected, 2 error; of the others 0, 1 or 3.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE = os.path.join(".plumbline", "cache")
MODELS = os.path.join(os.path.expanduser("~"), ".cache", "plumbline", "models")


def _model(spark: SparkSession, name: str | None):
    from plumbline.sources import config

    return config.resolved(spark, name, MODELS) if name else None


def _decided(results: DataFrame, cfg, accept: float | None, reject: float | None, inclusive: bool = False) -> DataFrame:
    """Decisions under the thresholds given, else those of the last path rule that matches, else the configuration's."""
    from plumbline.functions import paths, scoring

    given = accept is not None or reject is not None
    r = paths.path_thresholds(results, "file_path", [] if given else cfg.rules, accept if given else cfg.accept, reject if given else cfg.reject)
    change = scoring.overridden_inclusive if inclusive else scoring.overridden
    return r.withColumn("decision", change(F.col("decision"), F.col("score"), F.col("accept"), F.col("reject"))).drop("rule", "accept", "reject")


def _scorecard(results: DataFrame) -> list[str]:
    from plumbline.operators import records

    shown = F.get(F.filter("violations", lambda v: v["dimension"] == "ncd_exemplar_distance"), F.lit(0))["norm"]
    ncd = F.col("ncd") if "ncd" in results.columns else F.lit(None).cast("double")
    cards = records.scorecard(results.withColumn("compression_structure", F.get("dimensions", F.lit(3))["norm"]).withColumn("ncd", ncd).withColumn("ncd_shown", shown))
    names = [c for c in cards.columns if c[:2] in {f"{k}{i}" for k in "mq" for i in range(1, 6)} and c[2:3] == "_"]
    return [json.dumps({k: v for k, v in r.asDict().items() if v is not None}) for r in records.scorecard_summary(cards, names).collect()]  # a row a column


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    from plumbline.operators import attribution, code, order, reports
    from plumbline.plans.text_queries import highlighted
    from plumbline.sources import config, files

    cfg = config.load_config(a.path)
    if a.path == "-":
        found = files.one(spark, sys.stdin.read(), a.language or cfg.language or "python")
    elif a.diff:
        found = files.pre_filtered(files.changed(spark, a.path, a.diff, cfg.overrides, cfg.exclude))
    else:
        found = files.pre_filtered(files.scan(spark, a.path, cfg.overrides, cfg.exclude))
    m = _model(spark, a.model or cfg.model)
    results = _decided(code.evaluate_files(found, "file_path", m, a.top), cfg, a.accept, a.reject)
    r = order.once(reports.detailed(results, m.distribution if m else None))
    s = reports.summary(r).first().asDict()
    if a.format == "json":
        print("".join(reports.json_document(r, "file_path", {k: v for k, v in s.items() if not k.startswith("exit")})))
    elif a.format == "sarif":
        found_here = attribution.of_files(found, r, "file_path", m) if a.directives else None
        sys.stdout.writelines(reports.sarif_document(reports.sarif_results(r, "file_path", found_here), "file_path"))
        print()
    else:
        if a.rank and s["total_files"] > 1:
            lines = reports.text_lines(highlighted(r, "score", "file_path", a.bottom, a.bottom_pct), "file_path", a.classify, "rank").orderBy("rank")
        else:
            lines = reports.text_lines(r, "file_path", a.classify).orderBy("file_path")
        for x in lines.toLocalIterator():
            print(x["value"])
        if a.directives:
            for x in attribution.of_files(found, r, "file_path", m).orderBy("file_path", "place").toLocalIterator():
                print(f"  [{x['severity']}] {x['category']} {x['file_path']}:{x['start_line']}-{x['end_line']}")
        if a.rank and s["total_files"] == 1:
            print("note: ranks need several files")
        shown = "" if s["mean_percentile"] is None else f", mean percentile p{round(s['mean_percentile'])}"
        print(f"{s['total_files']} files, mean score {s['mean_score']:.4f}{shown}")
        if a.classify:
            print(f"{s['accepted']} accepted, {s['warned']} marginal, {s['rejected']} rejected")
    if a.scorecard:
        print("\n".join(_scorecard(r)), file=sys.stderr if a.format != "text" else sys.stdout)
    return s["exit_lenient"] if a.lenient else s["exit_strict"] if a.strict or cfg.strict else s["exit_code"]


def _check(spark: SparkSession, a: argparse.Namespace) -> int:
    """Staged files against their cache: only files whose content is new under this configuration are evaluated."""
    from plumbline.operators import code, order, records, reports
    from plumbline.sources import config, files

    cfg = config.load_config(a.path)
    strict = a.strict or (cfg.strict and not a.lenient)
    if not files.changed_paths(a.path):
        print("no staged files")
        return 0
    at = os.path.join(a.path, CACHE, config.config_hash(a.path) or "none")
    schema = "file_path string, content_sha256 string, decision string, score double"
    cache = order.once(spark.read.schema(schema).parquet(at)) if os.path.exists(os.path.join(at, "_SUCCESS")) else spark.createDataFrame([], schema)
    staged = files.changed(spark, a.path, None, cfg.overrides, cfg.exclude)
    fresh = records.cache_misses(staged, cache, "file_path", "content_sha256")
    scored = _decided(code.evaluate_files(fresh, "file_path", _model(spark, cfg.model)), cfg, None, None, inclusive=True)
    done = order.once(fresh.select("file_path", "content_sha256").join(scored, "file_path"))
    columns = ["file_path", "content_sha256", "decision", "score"]
    hits = cache.join(staged.select("file_path", "content_sha256"), ["file_path", "content_sha256"], "left_semi").withColumn("cached", F.lit(True))
    r = order.once(hits.select(*columns, "cached").unionByName(done.select(*columns, F.lit(False).alias("cached"))))
    records.refreshed(cache, done.select(*columns), "file_path").coalesce(1).write.mode("overwrite").parquet(at)
    for x in r.orderBy("file_path").toLocalIterator():
        print(f"{'[cache] ' if x['cached'] else ''}{x['file_path']}: {x['decision']} ({x['score']:.2f})")
    if a.scorecard and done.count():
        print("\n".join(_scorecard(done)))
    s = reports.summary(r.withColumn("percentile", F.lit(None).cast("double"))).first()
    if s["rejected"] or (strict and s["warned"]):
        print("blocked: files are rejected", file=sys.stderr)
        return 1
    return 0


def _train(spark: SparkSession, a: argparse.Namespace) -> int:
    from plumbline.operators import model, training
    from plumbline.sources import files

    m = training.train(files.scan(spark, a.path, binary="replace"), a.components, a.share, a.language, a.corpus_class)
    model.save(m, spark, a.out, a.force)
    print(json.dumps(model.inspect(m)))
    return 0


def _inspect(spark: SparkSession, a: argparse.Namespace) -> int:
    from plumbline.operators import model

    told = model.inspect(_model(spark, a.path))
    print(json.dumps(told, indent=2) if a.json else "\n".join(f"{k}: {v}" for k, v in told.items()))
    return 0


def _models(spark: SparkSession, a: argparse.Namespace) -> int:
    from plumbline.sources import config

    if a.action == "info":
        return _inspect(spark, argparse.Namespace(path=a.name, json=True))
    with open(a.registry, encoding="utf-8") as f:
        text = f.read()
    if a.action == "list":
        here = {n.removesuffix(".npz") for n in os.listdir(a.cache)} if os.path.isdir(a.cache) else set()
        for r in config.registry_entries(spark, text).orderBy("name").toLocalIterator():
            print(f"{r['name']}  {r['language'] or '-'}  {r['version'] or '-'}  {'cached' if r['name'].replace('/', '_') in here else 'remote'}")
        return 0
    entry = next((m for m in json.loads(text)["models"] if m["name"] == a.name), None)
    if entry is None:
        print(f"error: no model {a.name}", file=sys.stderr)
        return 1
    print(config.pulled(entry, a.cache, a.force))
    return 0


def _corpus(spark: SparkSession, a: argparse.Namespace) -> int:
    from plumbline.operators import order
    from plumbline.sources import config, sync

    targets, broken = config.load_manifests(a.manifest) if os.path.isdir(a.manifest) else (config.load_manifest(a.manifest), [])
    rows = order.once(sync.sync(spark, targets, a.out, a.force))
    for r in rows.orderBy("name").toLocalIterator():
        print(f"{r['status']:8} {r['name']} {'' if r['n_files'] is None else r['n_files']} {r['error'] or ''}".rstrip())
    for b in broken:
        print(f"failed   {b}")
    return 1 if broken or rows.where("status = 'failed'").count() else 0


def _benchmark(spark: SparkSession, a: argparse.Namespace) -> int:
    from plumbline.operators import benchmark, order, sinks, statistics
    from plumbline.sources import files

    evaluated = order.once(benchmark.evaluated_projects(files.scan(spark, a.path), _model(spark, a.model)))
    made = {k: [r.asDict() for r in v.collect()] for k, v in benchmark.run(evaluated).items()}  # a row a category, dimension or target
    if a.out:
        sinks.write_report(made, a.out)
    print(json.dumps(made, indent=2, sort_keys=True))
    if not a.baseline:
        return 0
    schema = "name string, baseline double, target double, direction string, met boolean"
    table = lambda rows: spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in schema.split(", ")) for r in rows], schema)
    with open(a.baseline, encoding="utf-8") as f:
        worse = statistics.regressions(table(made["targets"]), table(json.load(f)["targets"])).collect()
    for r in worse:
        print(f"regression: {r['name']} {r['previous_value']} -> {r['current_value']} ({r['kind']})", file=sys.stderr)
    return 1 if worse else 0


def _harness(spark: SparkSession, a: argparse.Namespace) -> int:
    from plumbline.operators import code, order, statistics
    from plumbline.sources import files

    score = lambda path, before: code.evaluate_files(files.scan(spark, path, excluded=None), "file_path").select("score", F.lit(before).alias("before"))
    print(statistics.harness_report(order.once(score(a.before, True).unionByName(score(a.after, False))), "score", F.col("before")))
    return 0


def _init(a: argparse.Namespace) -> int:
    from plumbline.sources import config

    path = os.path.join(a.path, config.CONFIG_NAME)
    if os.path.exists(path) and not a.force:
        return 1
    with open(path, "w", encoding="utf-8") as f:
        f.write(config.starter())
    ignore = os.path.join(a.path, ".gitignore")
    have = open(ignore, encoding="utf-8").read() if os.path.exists(ignore) else ""
    if ".plumbline/" not in have.splitlines():
        with open(ignore, "a", encoding="utf-8") as f:
            f.write(("\n" if have and not have.endswith("\n") else "") + ".plumbline/\n")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline")
    sub = p.add_subparsers(dest="command", required=True)

    def strictness(x: argparse.ArgumentParser) -> None:
        one = x.add_mutually_exclusive_group()
        one.add_argument("--strict", action="store_true")
        one.add_argument("--lenient", action="store_true")
        x.add_argument("--scorecard", action="store_true")

    e = sub.add_parser("evaluate")
    e.add_argument("path")
    for flag in ("--diff", "--language", "--model"):
        e.add_argument(flag)
    e.add_argument("--accept", type=float)
    e.add_argument("--reject", type=float)
    e.add_argument("--top", type=int, default=3)
    e.add_argument("--format", choices=["text", "json", "sarif"], default="text")
    e.add_argument("--rank", action="store_true")
    e.add_argument("--bottom", type=int)
    e.add_argument("--bottom-pct", type=float)
    e.add_argument("--classify", action="store_true")
    e.add_argument("--directives", action="store_true")
    strictness(e)
    c = sub.add_parser("check")
    c.add_argument("path", nargs="?", default=".")
    strictness(c)
    t = sub.add_parser("train")
    t.add_argument("path")
    t.add_argument("out")
    t.add_argument("--components", type=int)
    t.add_argument("--share", type=float, default=0.9)
    t.add_argument("--language")
    t.add_argument("--corpus-class", choices=["A", "B", "C"])
    t.add_argument("--force", action="store_true")
    i = sub.add_parser("inspect")
    i.add_argument("path")
    i.add_argument("--json", action="store_true")
    m = sub.add_parser("model")
    m.add_argument("action", choices=["list", "pull", "info"])
    m.add_argument("name", nargs="?")
    m.add_argument("--registry", default="registry.json")
    m.add_argument("--cache", default=MODELS)
    m.add_argument("--force", action="store_true")
    s = sub.add_parser("corpus")
    s.add_argument("action", choices=["sync"])
    s.add_argument("manifest")
    s.add_argument("out")
    s.add_argument("--force", action="store_true")
    b = sub.add_parser("benchmark")
    b.add_argument("path")
    b.add_argument("--model")
    b.add_argument("--baseline")
    b.add_argument("--out")
    h = sub.add_parser("harness")
    h.add_argument("before")
    h.add_argument("after")
    n = sub.add_parser("init")
    n.add_argument("path", nargs="?", default=".")
    n.add_argument("--force", action="store_true")
    return p


COMMANDS = {"evaluate": _evaluate, "check": _check, "train": _train, "inspect": _inspect, "model": _models, "corpus": _corpus, "benchmark": _benchmark, "harness": _harness}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "init":
        return _init(a)
    try:
        spark = SparkSession.builder.appName("plumbline").getOrCreate()
        return COMMANDS[a.command](spark, a)
    except Exception as x:  # the command's contract: an exit code for any error
        print(f"error: {x}", file=sys.stderr)
        return 2 if a.command == "check" else 3


if __name__ == "__main__":
    sys.exit(main())
