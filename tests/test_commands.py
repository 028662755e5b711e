import hashlib
import io
import json
import subprocess
import tarfile

import numpy as np
import pytest

from plumbline.__main__ import main
from plumbline.operators import code, model, reports
from plumbline.sources import config, sync


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "proj"
    (root / "lib").mkdir(parents=True)
    for k in range(4):
        body = "".join(f"    if x > {j}:\n        x = x + {j * k}\n" for j in range(3 * k + 1))
        (root / "lib" / f"m{k}.py").write_text(f"def f{k}(x):\n{body}    return x\n")
    return root


def test_evaluate_formats_and_rules(spark, project, capsys):
    # one file's rule accepts all, the other files are rejected
    (project / config.CONFIG_NAME).write_text('[thresholds]\naccept = 0.0\nreject = 0.000001\n[[paths]]\nglob = "lib/m1.py"\n[paths.thresholds]\naccept = 0.999999\nreject = 1.0\n')
    assert main(["evaluate", str(project), "--format", "json", "--scorecard"]) == 2
    got = capsys.readouterr()
    doc = json.loads(got.out)
    assert [(r["file_path"], r["decision"]) for r in doc["results"]] == [("lib/m0.py", "reject"), ("lib/m1.py", "accept"), ("lib/m2.py", "reject"), ("lib/m3.py", "reject")]
    s = doc["summary"]
    assert (s["total_files"], s["accepted"], s["rejected"], s["overall_decision"], s["mean_percentile"]) == (4, 1, 3, "reject", None)
    assert abs(s["mean_score"] - sum(r["score"] for r in doc["results"]) / 4) < 1e-9
    for r in doc["results"]:
        assert len(r["contributions"]) == 5 and abs(sum(c["weighted_contribution"] for c in r["contributions"]) - r["score"]) < 1e-9
        assert {"dimension", "raw_value", "normalized_value", "contribution"} == set(r["violations"][0]) and r["percentile_available"] is False
    assert len([x for x in got.err.splitlines() if x.startswith('{"name"')]) == 10

    assert main(["evaluate", str(project), "--format", "sarif", "--directives"]) == 2
    run = json.loads(capsys.readouterr().out)["runs"][0]
    results = [r for r in run["results"] if r["ruleId"] == "quality/decision"]
    assert [r["level"] for r in results] == ["error", "note", "error", "error"] and results[0]["message"]["text"].startswith("Score: 0.")
    assert results[0]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "lib/m0.py"}, "region": {"startLine": 1}}
    known = {r["id"] for r in run["tool"]["driver"]["rules"]}
    assert {r["ruleId"] for r in run["results"]} <= known and len(run["results"]) > len(results)

    # thresholds given win over the rules
    assert main(["evaluate", str(project), "--accept", "1.0", "--reject", "1.0", "--rank", "--bottom", "1", "--classify"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert [x.split()[0] for x in lines[:3]] == ["1", "2", "3"] and lines[3].startswith("*") and "4 accepted, 0 marginal, 0 rejected" in lines[-1]


def test_percentile_and_message(spark):
    knots = {"min": 0.0, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "max": 1.0}
    rows = spark.createDataFrame([(0.25, "accept"), (0.6, "warn")], "score double, decision string")
    from pyspark.sql import functions as F

    out = rows.select(reports.message(F.col("score"), reports.percentile(F.col("score"), knots), F.col("decision")).alias("a"), reports.message(F.col("score"), reports.percentile(F.col("score"), None), F.col("decision")).alias("b"))
    assert [tuple(r) for r in out.collect()] == [
        ("Score: 0.250 (p75 — better than 75% of training corpus) [accept]", "Score: 0.250 [accept]"),
        ("Score: 0.600 (p40 — better than 40% of training corpus) [warn]", "Score: 0.600 [warn]"),
    ]


def test_messages_round_as_sql_does(spark):
    from pyspark.sql import functions as F

    scores = [k / 2000 for k in range(2001)] + [k / 1024 for k in range(1025)]  # 0.0625 is a tie, 0.4125 lies just under one
    of = reports.message(F.col("score"), F.lit(None).cast("double"), F.lit("warn"))
    shown = spark.createDataFrame([(x,) for x in scores], "score double").select("score", of.alias("m"), reports.fixed(F.col("score"), 4).alias("four"), reports.fixed(F.col("score") * 100, 0).alias("none")).collect()
    assert [tuple(r)[1:] for r in shown] == [(f"Score: {x:.3f} [warn]", f"{x:.4f}", f"{x * 100:.0f}") for x, *_ in shown]


def test_check_uses_its_cache(spark, project, capsys):
    git = lambda *x: subprocess.run(["git", "-C", str(project), *x], check=True, capture_output=True)
    git("init", "-q")
    assert main(["check", str(project)]) == 0 and "no staged files" in capsys.readouterr().out
    (project / config.CONFIG_NAME).write_text("[thresholds]\naccept = 0.999\nreject = 1.0\n")
    git("add", "lib")
    assert main(["check", str(project)]) == 0
    assert "[cache]" not in capsys.readouterr().out
    assert main(["check", str(project), "--scorecard"]) == 0
    out = capsys.readouterr().out
    assert out.count("[cache]") == 4
    (project / "lib" / "m0.py").write_text("def other(y):\n    return y * 2\n")
    git("add", "lib")
    assert main(["check", str(project)]) == 0
    assert capsys.readouterr().out.count("[cache]") == 3
    # another configuration has a cache of its own; everything is rejected now
    (project / config.CONFIG_NAME).write_text("[thresholds]\naccept = 0.0\nreject = 0.000001\n")
    assert main(["check", str(project)]) == 1
    assert "[cache]" not in capsys.readouterr().out
    # warned files block only if strict
    (project / config.CONFIG_NAME).write_text("strict = true\n[thresholds]\naccept = 0.0\nreject = 1.0\n")
    assert main(["check", str(project), "--lenient"]) == 0 and main(["check", str(project)]) == 1
    assert main(["check", str(project / "missing")]) == 2


def _archive(path, files):
    with tarfile.open(path, "w:gz") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def test_corpus_sync(spark, tmp_path, capsys):
    _archive(tmp_path / "a.tar.gz", {"top/src/a.py": b"one", "top/src/b.txt": b"two", "top/../../evil.py": b"no", "top/tests/c.py": b"three"})
    _archive(tmp_path / "b.tar.gz", {"top/x.rs": b"fn x() {}"})

    def manifest(ref, extra=""):
        body = f'[corpus]\nname = "c"\nclass = "A"\n[[target]]\nname = "a"\nurl = "{tmp_path}/a.tar.gz"\nref = "{ref}"\ninclude = ["**/*.py"]\nexclude = ["tests/**"]\n'
        body += f'[[target]]\nname = "b"\nurl = "file://{tmp_path}/b.tar.gz"\nref = "v1"\ninclude = ["**"]\n' + extra
        (tmp_path / "m.toml").write_text(body)
        return main(["corpus", "sync", str(tmp_path / "m.toml"), str(tmp_path / "out")])

    files = lambda: sorted((r["name"], r["file_path"], r["language"], r["source"]) for r in spark.read.parquet(str(tmp_path / "out" / "files")).collect())
    status = lambda: [x.split()[:2] for x in capsys.readouterr().out.splitlines()]
    assert manifest("v1") == 0
    assert status() == [["synced", "a"], ["synced", "b"]]
    assert files() == [("a", "src/a.py", "python", "one"), ("b", "x.rs", "rust", "fn x() {}")]
    assert manifest("v1") == 0 and status() == [["skipped", "a"], ["skipped", "b"]]
    # a new ref is taken again and replaces its files; a broken target fails alone and keeps nothing
    _archive(tmp_path / "a.tar.gz", {"top/src/new.py": b"1"})
    assert manifest("v2", f'[[target]]\nname = "z"\nurl = "{tmp_path}/none.tar.gz"\nref = "v1"\ninclude = ["**"]\n') == 1
    assert status() == [["synced", "a"], ["skipped", "b"], ["failed", "z"]]
    assert files() == [("a", "src/new.py", "python", "1"), ("b", "x.rs", "rust", "fn x() {}")]
    assert sorted((r["name"], r["ref"], r["n_files"]) for r in spark.read.parquet(str(tmp_path / "out" / "ledger")).collect()) == [("a", "v2", 1), ("b", "v1", 1)]
    assert sync.location("https://x/y", "v1") == "https://x/y/archive/refs/tags/v1.tar.gz" and sync.location("https://x/y", "a" * 40) == f"https://x/y/archive/{'a' * 40}.tar.gz"


def test_models(spark, tmp_path, capsys):
    m = model.synthetic(2)
    np.savez(tmp_path / "m.npz", mean=m.mean, std=m.std, projection_matrix=m.w)
    data = (tmp_path / "m.npz").read_bytes()
    entry = {"name": "org/m", "language": "python", "version": "1", "download_url": str(tmp_path / "m.npz"), "sha256": hashlib.sha256(data).hexdigest()}
    (tmp_path / "r.json").write_text(json.dumps({"models": [entry, entry | {"name": "bad", "sha256": "0"}]}))
    where = ["--registry", str(tmp_path / "r.json"), "--cache", str(tmp_path / "cache")]
    assert main(["model", "pull", "org/m", *where]) == 0
    assert main(["model", "pull", "bad", *where]) == 3 and main(["model", "pull", "none", *where]) == 1
    capsys.readouterr()
    assert main(["model", "list", *where]) == 0
    assert [x.split()[::3] for x in capsys.readouterr().out.splitlines()] == [["bad", "remote"], ["org/m", "cached"]]
    assert config.resolved(spark, "org/m", str(tmp_path / "cache")).k == 2
    assert main(["model", "info", str(tmp_path / "m.npz")]) == 0 and json.loads(capsys.readouterr().out)["n_components"] == 2


def test_exemplars_are_trained_saved_and_scored(spark, project, tmp_path):
    from plumbline.operators import training
    from plumbline.sources import files

    for k in range(4, 12):
        body = "".join(f"    while x < {j}:\n        x = g(x, {j}) * {k}\n" for j in range(k))
        (project / "lib" / f"m{k}.py").write_text(f"def f{k}(x):\n{body}    return x\n")
    found = files.scan(spark, str(project))
    m = training.train(found, components=2)
    texts = {r["source"].rstrip("\n") for r in found.collect()}
    assert 1 <= len(m.exemplars) <= 2 and {x.rstrip("\n") for x in m.exemplars} <= texts
    model.save(m, spark, str(tmp_path / "model"))
    back = model.load(spark, str(tmp_path / "model"))
    assert back.exemplars == m.exemplars
    rows = code.evaluate_files(found, "file_path", back).collect()
    assert len(rows) == 12
    for r in rows:
        assert 0 <= r["ncd"] <= 1 and abs(sum(d["weight"] for d in r["dimensions"]) - 1) < 1e-9 and r["dimensions"][4]["weight"] == 0.1
    bare = code.evaluate_files(found, "file_path", model.Model(**(back.__dict__ | {"exemplars": []}))).first()
    assert bare["dimensions"][4]["weight"] == 0.0


def test_benchmark_and_init(spark, project, tmp_path, capsys):
    assert main(["benchmark", str(project), "--out", str(tmp_path / "b.json")]) == 0
    made = json.loads(capsys.readouterr().out)
    assert made == json.loads((tmp_path / "b.json").read_text()) and made["targets"][0]["name"] == "sc_001_file_count" and made["targets"][0]["baseline"] == 4.0
    made["targets"][0]["baseline"] = 400.0
    (tmp_path / "old.json").write_text(json.dumps(made))
    assert main(["benchmark", str(project), "--baseline", str(tmp_path / "old.json")]) == 1
    assert main(["init", str(project)]) == 0 and main(["init", str(project)]) == 1 and main(["init", str(project), "--force"]) == 0
    assert (project / ".gitignore").read_text() == ".plumbline/\n"
