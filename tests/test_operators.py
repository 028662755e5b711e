import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import code, exemplars, model, order, records, statistics, syntax, wl
from plumbline.operators.code_samples import SAMPLES
from plumbline.streaming import steer


def test_percentiles_match_numpy_with_ties_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(order, "RANGE_VALUES", 20)
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 500), rng.integers(0, 200, 500), strict=True)]
    df = spark.createDataFrame(rows, "g int, v double")
    for r in order.percentiles(df, "v", {"a": 0.0, "b": 0.37, "c": 0.95}, ["g"]).collect():
        own = [v for g, v in rows if g == r["g"]]
        assert np.allclose([r["a"], r["b"], r["c"]], np.percentile(own, [0, 37, 95])) and r["n"] == len(own)
    ranks = sorted((x["v"], x["rank"]) for x in order.ranked(df.withColumn("k", F.monotonically_increasing_id()), "v", [F.col("k")]).collect())
    assert [r for _, r in ranks] == list(range(1, 501))


def test_mann_whitney(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (2.0, False), (4.0, False), (None, True)], "v double, f boolean")
    r = statistics.mann_whitney(df, "v", F.col("f")).first()
    assert (r["n1"], r["n2"], r["u"], r["tie_sum"]) == (2, 2, 0.5, 6.0)
    assert statistics.mann_whitney_p(0, 2, 0, 0) == 1.0 and statistics.mann_whitney_p(30, 30, 0.0, 0.0) < 1e-6


def test_cohens_d_and_spearman_edges(spark):
    df = spark.createDataFrame([(1.0, True), (1.0, True), (1.0, False), (1.0, False)], "v double, f boolean")
    assert statistics.cohens_d(df, "v", F.col("f")).first()["d"] == 0.0
    assert statistics.spearman(df.withColumn("w", F.col("v")), "v", "w").first()["rho"] == 0.0
    up = spark.createDataFrame([(i, i * i) for i in range(9)], "x int, y int")
    assert abs(statistics.spearman(up, "x", "y").first()["rho"] - 1) < 1e-12


def test_kappa_and_majority(spark):
    rows = [(k, r, v) for k in range(6) for r, v in ((1, "accurate"), (2, "partial" if k else "inaccurate"))] + [(9, 1, "accurate"), (9, 2, "accurate"), (9, 3, "inaccurate")]
    df = spark.createDataFrame(rows, "k int, rater int, rating string")
    r = statistics.kappa(df, ["k"], "rating", "rater").first()
    assert r["pairs"] == 6 and abs(r["kappa"] - 0.0) < 1e-12
    assert {x["k"]: x["rating"] for x in statistics.majority(df, ["k"], "rating").collect()}[9] == "accurate"
    assert statistics.kappa(df.where("k < 3"), ["k"], "rating", "rater").first()["kappa"] is None


def test_regressions(spark):
    schema = "name string, baseline double, target double, direction string, met boolean"
    old = spark.createDataFrame([("a", 1.0, 0.5, "higher_is_better", True), ("b", 0.1, 0.4, "lower_is_better", True), ("c", 1.0, 2.0, "higher_is_better", False)], schema)
    new = spark.createDataFrame([("a", 0.4, 0.5, "higher_is_better", False), ("b", 0.2, 0.4, "lower_is_better", True), ("c", 0.95, 2.0, "higher_is_better", False)], schema)
    assert {r["name"]: r["kind"] for r in statistics.regressions(new, old).collect()} == {"a": "failing", "b": "worse"}


def test_pca_projection_and_decomposition(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 6)) + 0.01 * rng.normal(size=(60, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, [float("nan")] * 6)], "id int, vec array<double>")
    m = model.calibrate(df, "vec", model.pca(df, "vec"))
    assert m.k == 2 and sum(m.evr) > 0.99
    w = np.array(m.w)
    assert np.allclose(w.T @ w, np.eye(2), atol=1e-9) and all(w[np.argmax(np.abs(w[:, j])), j] > 0 for j in range(2))
    p = model.project(df.where("id < 60"), "vec", m)
    rows = model.contributions(p, "id").where("dimension = 'manifold_drift'").groupBy("id").agg(F.sqrt(F.sum(F.col("contribution") ** 2)).alias("s")).join(p.select("id", "l_drift"), "id").collect()
    assert all(abs(r["s"] - r["l_drift"]) < 1e-9 for r in rows)
    wide = model.Model(m.mean, m.std, np.linalg.qr(rng.normal(size=(6, 5)))[0].tolist())
    fast = model.project(df.where("id < 60"), "vec", wide).orderBy("id").collect()
    z = ((x - m.mean) / np.array(m.std)) @ np.array(wide.w)
    assert np.allclose([r["z"] for r in fast], z)
    model.save(m, spark, str(tmp_path / "m"))
    assert model.load(spark, str(tmp_path / "m")).w == m.w
    with pytest.raises(Exception, match="(?i)exist"):
        model.save(m, spark, str(tmp_path / "m"))
    with pytest.raises(ValueError):
        model.pca(df, "vec", k=6)


def test_synthetic_model_is_orthonormal():
    w = np.array(model.synthetic().w)
    assert np.allclose(w.T @ w, np.eye(3)) and model.synthetic().w == model.synthetic().w


def test_diversity_needs_groups(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [2.0, 1.0])], "label int, v array<double>")
    with pytest.raises(ValueError):
        model.diversity(df, "v", "label")


def test_nearest_exemplar(spark):
    texts = spark.createDataFrame([(1, "the quick brown fox " * 5), (2, "short"), (3, "zzzz yyyy xxxx wwww " * 5)], "k long, t string")
    ex = spark.createDataFrame([(7, "zzzz yyyy xxxx wwww " * 5), (8, "the quick brown fox " * 5), (9, "the quick brown fox " * 5)], "e long, t string")
    got = {r["k"]: (r["nearest_exemplar_id"], r["ncd"]) for r in exemplars.nearest(texts, "k", "t", ex, "e", "t").collect()}
    assert got[1][0] == 8 and got[2] == (None, None) and got[3][0] == 7


def test_halstead_two_ways(spark):
    files = code.samples(spark)
    by_row = {r["file_id"]: r for r in code.halstead_table(code.node_table(files, "file_id"), "file_id").collect()}
    for i, (_, language, text) in enumerate(SAMPLES):
        root = syntax.parse(text, language)
        if root is not None:
            h = code.halstead(root)
            assert abs(by_row[i]["volume"] - h["volume"]) < 1e-9 and abs(by_row[i]["effort"] - h["effort"]) < 1e-6


def test_halstead_by_hand():
    h = code.halstead_of(2, 4, 3, 6)
    assert abs(h["volume"] - 9 * np.log2(6)) < 1e-12 and h["difficulty"] == 1.5
    assert code.halstead_of(1, 0, 5, 0)["volume"] == 0


def test_units_warnings_and_histograms(spark):
    rows = {(r["file_id"], r["unit_idx"]): r for r in code.unit_table(code.samples(spark), "file_id").collect()}
    assert rows[0, 0]["name"] == "add" and rows[6, 0]["partial_parse"] and rows[16, 0]["warning"] == code.WARN_UNSUPPORTED
    assert rows[7, 0]["name"] == "<module>" and all(len(r["features"]) == 69 for r in rows.values())
    assert all(abs(sum(r["features"][5:]) - 1) < 1e-9 for r in rows.values() if r["warning"] != code.WARN_UNSUPPORTED)
    assert rows[10, 0]["name"] == "add"


def test_declarations_and_regions():
    by_path = {p: (s, lang) for p, lang, s in SAMPLES}
    d = lambda p: code.declarations(*by_path[p])
    assert d("src/types.py")[2:] == (True, True) and d("src/table.py")[2:] == (True, False) and d("src/plain.py")[1] == 0 and d("src/shape.ts")[3]
    methods = "from dataclasses import dataclass\n@dataclass\nclass A:\n    x: int\n    def f(self):\n        return 1\n"
    assert code.declarations(methods, "python")[0] == []
    labels = [(r[0], r[1][0][0]) for r in code.regions(*by_path["src/with_tests.py"])]
    assert labels == [("production", 1), ("test", 8)]
    assert [r[0] for r in code.regions(*by_path["src/lib.rs"])] == ["production", "test"] and code.regions(*by_path["src/plain.py"]) == []


def test_evaluate_files_in_bounds(spark):
    rows = {r["file_id"]: r for r in code.evaluate_files(code.samples(spark), "file_id", model.synthetic()).collect()}
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rows[7]["decision"] == "accept" and rows[8]["score"] == 0 and rows[8]["violations"] == []


def test_wl_counts(spark):
    nodes = spark.createDataFrame([(0, "a", None, "r"), (0, "b", "a", "x"), (0, "c", "a", "x")], "tree int, node_id string, parent_id string, type string")
    assert wl.histogram(nodes, 1).agg(F.sum("n")).first()[0] == 6


def test_spans(spark):
    b = spark.createDataFrame([(1, 3, 4), (1, 8, 10)], "k int, start_line int, end_line int")
    f = spark.createDataFrame([(1, 10), (2, 5)], "k int, n_lines int")
    got = sorted((r["k"], r["label"], r["start_line"], r["end_line"]) for r in records.spans(b, f, "k").collect())
    assert got == [(1, "production", 1, 2), (1, "production", 5, 7), (1, "test", 3, 4), (1, "test", 8, 10), (2, "production", 1, 5)]


def test_steer_batch_equals_stream(spark, tmp_path):
    rows = [(s, i, 0.1 * ((s + i) % 7)) for s in range(3) for i in range(6)]
    steps = spark.createDataFrame(rows, "s long, i int, e double")
    batch = sorted(tuple(r) for r in steer.fold(steps, "s", "i", "e").collect())
    for part in range(2):  # two micro-batches
        steps.where(F.col("i").between(part * 3, part * 3 + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = steer.stream(source, "s", "i", "e").writeStream.outputMode("append").format("memory").queryName("steered").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("steered").collect())
    assert len(got) == len(batch) and np.allclose([r[2:] for r in got], [r[2:] for r in batch])


def test_steer_config():
    with pytest.raises(ValueError):
        steer.PID(alpha=0)
    assert steer.PID(i_max=0).step((0, 0, 0.7, 0.9), 0.5)[0][1] == 0


def test_ratings_and_discrimination(spark, tmp_path):
    import json

    functions = [{"file": f"f{k}.py", "function_name": "f", "language": "python", "human_rating": r, "n_raters": 3} for k, r in enumerate([1.0, 3.0, 5.0])]
    (tmp_path / "b.json").write_text(json.dumps({"version": "1", "description": "", "functions": functions}, indent=1))
    rated = statistics.human_ratings(spark, str(tmp_path / "b.json"))
    scored = rated.withColumn("score", F.lit(1.0) - F.col("human_rating") / 10).withColumn("assessment", F.when(F.col("score") >= 0.6, "reject").otherwise("accept"))
    r = statistics.rating_report(scored).first()
    assert abs(r["rho"] - 1) < 1e-12 and r["n_reject"] == 2 and r["excellent_rejected"] == 0
    two = spark.createDataFrame([("py", 0.1, True), ("py", 0.2, True), ("py", 0.8, False), ("py", 0.9, False)], "lang string, score double, known boolean")
    assert statistics.discrimination(two, "score", F.col("known"), "lang").first()["passed"]


def test_attributions_benchmark_and_requests(spark):
    import json

    from plumbline.operators import attribution, benchmark

    files = code.samples(spark)
    m = model.synthetic()
    units = code.unit_table(files, "file_id").where("unit_idx = 0")
    rows = attribution.attributions(code.evaluate_files(files, "file_id", m), model.project(units, "features", m), "file_id", units)
    first = [r for r in rows.collect() if r["file_id"] == 1]
    assert [r["place"] for r in first] == list(range(5)) and len(first[0]["features"]) == 3 and not first[4]["available"] and first[0]["unit"] == "scan"
    assert json.loads(attribution.to_json(rows, "file_id").where("file_id = 1").first()["attribution"])[0]["dimension"] == "manifold_drift"
    out = benchmark.run(benchmark.evaluated_projects(files))
    assert {r["name"] for r in out["targets"].collect()} == {"sc_001_file_count", "sc_002_impl_vs_init_gap", "sc_003_dimension_discrimination"}
    assert sum(r["n"] for r in out["categories"].collect()) == len(SAMPLES)
    assert [r["label"] for r in benchmark.evaluate_regions(files, "file_id").where("file_id = 2").orderBy("region_idx").collect()] == ["production", "test"]
    body = json.dumps({"files": [{"source": "x = 1\n" * 30, "language": "python", "file_path": "a"}, {"source": "y" * (benchmark.MAX_FILE_BYTES + 1), "language": "python", "file_path": "b"}]})
    got = {r["file_path"]: r for r in benchmark.evaluate_requests(spark.createDataFrame([(body,)], "j string"), "j").collect()}
    assert got["a"]["score"] is not None and got["b"]["warning"] == "file too large" and got["b"]["score"] is None


def test_deeply_nested_source_is_an_error_tree(spark):
    from plumbline.operators import code

    source = "x = " + "-" * 30_000 + "1\n"
    files = spark.createDataFrame([(1, source, "python"), (2, "def f(a):\n    return a\n", "python")], "k long, source string, language string")
    got = {r["k"]: r["partial_parse"] for r in code.unit_table(files, "k").where("unit_idx = 0").collect()}
    assert got[1] and not got[2]
    assert code.declaration_table(files, "k").count() == 2


def test_wl_labels_are_separated():
    from plumbline.operators import code
    from plumbline.operators.syntax import Node

    leaf = lambda t: Node(t, 1, 1, "")
    root = Node("r", 1, 1, "", [leaf("b"), leaf("a")])
    d = code._digest
    first = [d("r"), d("b"), d("a")]
    second = [d(str(d("r")) + "||" + "||".join(sorted([str(d("b")), str(d("a"))]))), d(str(d("b")) + "||"), d(str(d("a")) + "||")]
    want = [0.0] * 64
    for v in first + second:
        want[v % 64] += 1 / 6
    assert code.wl_histogram(root, 1) == pytest.approx(want)


def test_nearest_keeps_repeated_keys_and_any_type(spark, monkeypatch):
    import random
    import zlib

    from plumbline.functions.text_metrics import MIN_BYTES, NCD_LEVEL
    from plumbline.operators import exemplars

    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + rng.choice("xyz") for _ in range(n))
    texts = [(1.5, say(40)), (1.5, say(40)), (2.5, "short"), (2.5, None), (3.5, say(4000))]
    chosen = [(f"e{k}", say(60 + 400 * k)) for k in range(5)]
    t, e = spark.createDataFrame(texts, "k double, t string"), spark.createDataFrame(chosen, "e string, t string")
    size = lambda b: len(zlib.compress(b, NCD_LEVEL))
    want = []
    for k, x in texts:
        x = (x or "").encode()
        d = [(round(exemplars.ncd(x, y.encode(), size(x), size(y.encode())), 9), i) for i, (_, y) in enumerate(chosen)]
        want.append((k, *((f"e{min(d)[1]}", min(d)[0]) if len(x) >= MIN_BYTES else (None, None))))
    for most in (exemplars.MAX_BYTES, 1_000):  # one block, several blocks
        monkeypatch.setattr(exemplars, "MAX_BYTES", most)
        got = [(r["k"], r["nearest_exemplar_id"], None if r["ncd"] is None else round(r["ncd"], 9)) for r in exemplars.nearest(t, "k", "t", e, "e", "t").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
