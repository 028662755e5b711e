import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.functions import lines, paths, scoring, text_metrics


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_entropy_and_zlib(spark):
    df = spark.createDataFrame([("",), (None,), ("aaaa",), ("abcd",), ("é" * 60,)], "t string")
    got = [tuple(r) for r in df.select(text_metrics.byte_entropy("t"), text_metrics.zlib_size("t")).collect()]
    assert [g[0] for g in got] == [0.0, 0.0, 0.0, 2.0, 1.0]
    assert got[0][1] == got[1][1] == 0 and got[4][1] == len(zlib.compress(("é" * 60).encode(), 6))


def test_ratio_birkhoff_distance(spark):
    n = F.lit
    r = one(spark, small=text_metrics.compression_ratio(n(49), n(10)), big=text_metrics.compression_ratio(n(50), n(10)), none=text_metrics.birkhoff(n(0), n(0.0), n(0)),
            clamp=text_metrics.birkhoff(n(10), n(1.0), n(99)), same=text_metrics.distance(n(10), n(10), n(10)), zero=text_metrics.distance(n(0), n(0), n(0)))
    assert r["small"] is None and r["big"] == 0.2 and r["none"] == 0 and r["clamp"] == 0 and r["same"] == 0 and r["zero"] == 0


def test_weights_sum_to_one():
    assert all(abs(sum(w) - 1) < 1e-12 for w in scoring.WEIGHTS.values())


@pytest.mark.parametrize("score,expected", [(0.4, "warn"), (0.6, "warn"), (0.399, "accept"), (0.601, "reject")])
def test_strict_bounds(spark, score, expected):
    assert one(spark, d=scoring.decision(F.lit(score)))["d"] == expected


def test_critic_label_is_inclusive(spark):
    assert one(spark, d=scoring.assessment(F.lit(0.6)))["d"] == "reject"


def test_percentile_knots(spark):
    knots = {k: F.lit(v) for (k, _), v in zip(scoring.PERCENTILE_KNOTS, [0.38, 0.45, 0.52, 0.61, 0.72, 0.81, 0.93], strict=True)}
    at = lambda s: one(spark, p=scoring.quality_percentile(F.lit(s), knots))["p"]
    assert at(0.2) == 100 and at(1.0) == 0 and at(0.61) == 50 and abs(at(0.565) - 62.5) < 1e-9
    flat = {k: F.lit(0.5) for k, _ in scoring.PERCENTILE_KNOTS}
    assert one(spark, p=scoring.quality_percentile(F.lit(0.9), flat))["p"] == 50


def test_damping_never_accepts(spark):
    dims = scoring.dimensions(F.lit(0.1), F.lit(0.1), F.lit(7.9), F.lit(0.1), F.lit(None).cast("double"), 1.0, 1.0)
    r = one(spark, plain=scoring.damped_loss(dims, F.lit(False)), damped=scoring.damped_loss(dims, F.lit(True)))
    assert r["plain"] < 0.4 and r["damped"] == 0.4


def test_violations_order_and_zero_loss(spark):
    dims = scoring.dimensions(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(4.0), F.lit(0.5), F.lit(None).cast("double"), 1.0, 1.0)
    v = one(spark, v=scoring.violations(dims, scoring.loss(dims), 3))["v"]
    assert [x["dimension"] for x in v] == ["token_entropy", "compression_structure"] and abs(sum(x["share"] for x in v) - 1) < 1e-12
    assert one(spark, v=scoring.violations(dims, F.lit(0.0), 3))["v"] == []


def test_overrides(spark):
    none = F.lit(None).cast("double")
    f = lambda s, a, r: one(spark, d=scoring.overridden(F.lit("accept"), F.lit(s), a, r))["d"]
    assert f(0.5, F.lit(0.4), F.lit(0.6)) == "warn" and f(0.7, none, F.lit(0.6)) == "reject" and f(0.5, none, F.lit(0.6)) == "accept" and f(0.5, none, none) == "accept"


@pytest.mark.parametrize("glob,path,ok", [
    ("src/**/*.py", "src/a/b/c.py", True), ("src/**/*.py", "src/c.py", True), ("src/*.py", "src/a/c.py", False), ("**", "a/b", True), ("a/**", "a", True), ("a/**", "ab", False), ("*.p?", "x.py", True), ("[!a]*.py", "a.py", False),
])
def test_path_globs(spark, glob, path, ok):
    assert one(spark, m=F.lit(path).rlike(paths.path_glob_regex(glob)))["m"] is ok


def test_last_rule_wins_whole(spark):
    df = spark.createDataFrame([("src/x/a.py",), ("lib/a.py",)], "p string")
    got = {r["p"]: (r["rule"], r["accept"], r["reject"]) for r in paths.path_thresholds(df, "p", [("src/*", 0.1, 0.9), ("*/x/*", None, 0.5)], 0.4, 0.6).collect()}
    assert got == {"src/x/a.py": (1, None, 0.5), "lib/a.py": (-1, 0.4, 0.6)}


@pytest.mark.parametrize("path,content,expected", [
    ("a/test_x.py", "", "test"), ("pkg/__init__.py", "from .a import b\n", "init"), ("pkg/__init__.py", "x = 1\ny = 2\nimport z\n", "implementation"), ("c/d.toml", None, "schema"), ("gen/a.py", None, "generated"),
    ("a/b.py", "# Generated by tool\n", "generated"), ("models/a.py", "class A:\n  pass\n", "schema"), ("models/a.py", "def f():\n  pass\n", "implementation"), ("a/b.txt", None, "unknown"), ("a/b.rs", "", "implementation"),
])
def test_categories(spark, path, content, expected):
    assert one(spark, c=paths.category(F.lit(path), F.lit(content).cast("string")))["c"] == expected


def test_lines(spark):
    js = "/* a\n b */\ncode();\n// no\n\n/* one */ x\ny();\n"
    barrel = "import a\nfrom b import (\n    c,\n)\n__all__ = ['c']\n"
    r = one(spark, js=lines.code_lines(F.lit(js), "javascript"), py=lines.code_lines(F.lit("a\n# b\n\n c"), "python"), barrel=lines.is_barrel(F.lit(barrel), "python"), no=lines.is_barrel(F.lit("x = f(1)\ny = g(2)\n"), "python"),
            n=lines.line_count(F.lit("a\nb\n\n")), cut=lines.cut_lines(F.lit("a\nb\nc"), F.lit(2), F.lit(3)))
    assert (r["js"], r["py"], r["barrel"], r["no"], r["n"], r["cut"]) == (2, 2, True, False, 2, "b\nc")


def test_exit_codes(spark):
    f = lambda r, w, **k: one(spark, x=scoring.exit_code(F.lit(r), F.lit(w), **k))["x"]
    assert (f(1, 0), f(0, 1), f(0, 0), f(0, 1, strict=True), f(0, 1, lenient=True), f(1, 1, lenient=True)) == (2, 1, 0, 2, 0, 2)
