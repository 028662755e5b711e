import io
import json
import subprocess
import tarfile

import pytest

from plumbline.__main__ import main
from plumbline.operators import sinks, training
from plumbline.sources import config, files


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    for name, data in {"a.py": b"def f(x):\n    return x\n", "sub/b.rs": b"fn f() {}\n", "node_modules/c.js": b"x", "bad.py": b"\xff\xfe", "skip/d.py": b"y = 1\n", "e.txt": b"z"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return str(root)


def test_scan(spark, tree):
    names = lambda **k: sorted(r["file_path"] for r in files.scan(spark, tree, **k).collect())
    assert names() == ["a.py", "skip/d.py", "sub/b.rs"]
    assert names(exclude_globs=["skip/*"]) == ["a.py", "sub/b.rs"]
    assert "node_modules/c.js" in names(excluded=None)
    assert "e.txt" in names(overrides={".txt": "python"}) and "bad.py" in names(binary="replace")


def test_git_sources(spark, tree):
    git = lambda *a: subprocess.run(["git", "-C", tree, "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "a.py")
    git("commit", "-qm", "one")
    git("add", "sub/b.rs")
    assert files.changed_paths(tree) == ["sub/b.rs"] and [r["file_path"] for r in files.changed(spark, tree).collect()] == ["sub/b.rs"]
    git("commit", "-qm", "two")
    h = files.history(spark, tree, 5).collect()
    assert {r["file_path"]: r["source"] for r in h} == {"a.py": "def f(x):\n    return x\n", "sub/b.rs": "fn f() {}\n"}


def test_archive(spark, tmp_path):
    training.register(spark)
    path = tmp_path / "x.tar.gz"
    with tarfile.open(path, "w:gz") as t:
        for name, data in {"top/src/a.py": b"one", "top/src/b.txt": b"two", "top/../../evil.py": b"no", "top/tests/c.py": b"three"}.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    df = spark.read.format("plumbline_archive").option("path", str(path)).option("include", "**/*.py").option("exclude", "tests/**").load()
    assert [(r["file_path"], r["source"]) for r in df.collect()] == [("src/a.py", "one")]


def test_config(tmp_path):
    text = 'strict = true\nexclude = ["x/*"]\n[thresholds]\naccept = 0.3\n[[paths]]\nglob = "a/*"\n[paths.thresholds]\nreject = 0.5\n[language_overrides]\n".inc" = "c"\n'
    (tmp_path / config.CONFIG_NAME).write_text(text)
    (tmp_path / "deep").mkdir()
    c = config.load_config(str(tmp_path / "deep"))
    assert c.strict and c.accept == 0.3 and c.reject is None and c.rules == [("a/*", None, 0.5)] and c.overrides == {".inc": "c"}
    for bad in ("nope = 1", "[thresholds]\naccept = 0.7\nreject = 0.5", "[thresholds]\naccept = 2.0"):
        with pytest.raises(ValueError):
            config.parse_config(bad)


def test_manifests(spark, tmp_path):
    one = '[corpus]\nname = "c"\nclass = "A"\n[[target]]\nname = "t"\nurl = "https://x/y"\nref = "v1"\ninclude = ["**"]\n'
    (tmp_path / "one.toml").write_text(one)
    (tmp_path / "all.toml").write_text('[composition]\nname = "k"\nsources = ["one.toml"]\n')
    (tmp_path / "bad.toml").write_text('[corpus]\nname = "c"\nclass = "Z"\n')
    assert len(config.load_manifest(str(tmp_path / "all.toml"))) == 1
    found, failed = config.load_manifests(str(tmp_path))
    assert len(found) == 2 and len(failed) == 1
    assert config.targets_table(spark, found[:1]).first()["entry_hash"].startswith("sha256:")
    with pytest.raises(ValueError):
        config.manifest_targets(one + '[[target]]\nname = "t"\nurl = "u"\nref = "r"\ninclude = ["**"]\n')


def test_registry(spark):
    remote = config.registry_entries(spark, json.dumps({"models": [{"name": "a"}, {"name": "b"}]}))
    assert [r["name"] for r in config.not_local(remote, remote.where("name = 'a'")).collect()] == ["b"]
    assert sorted(r["name"] for r in config.local_models(remote.where("name = 'a'"), remote).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        config.verified(b"x", "0")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a.py", 0.7, "reject"), ("b.py", 0.1, "accept")], "file_path string, score double, decision string")
    d = spark.createDataFrame([("a.py", "token_entropy", "high")], "file_path string, dimension string, severity string")
    doc = json.loads(sinks.sarif(df, d, "file_path"))
    assert [(r["ruleId"], r["level"]) for r in doc["runs"][0]["results"]] == [("directive/token-entropy", "error"), ("quality/decision", "error"), ("quality/decision", "note")]
    assert "2 files, 1 rejected" in sinks.text_report(df, "file_path")
    sinks.write_json(df, ["file_path", "score"], str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_train_and_command_line(spark, tmp_path, capsys):
    root = tmp_path / "corpus"
    root.mkdir()
    for k in range(12):
        body = "".join(f"    if x > {j}:\n        x = x + {j * k}\n" for j in range(k + 1))
        (root / f"m{k}.py").write_text(f"def f{k}(x):\n{body}    return x\n")
    assert main(["train", str(root), str(tmp_path / "model"), "--language", "python"]) == 0
    assert main(["train", str(root), str(tmp_path / "model")]) == 3  # exists
    assert main(["inspect", str(tmp_path / "model")]) == 0
    assert main(["evaluate", str(root), "--model", str(tmp_path / "model")]) in (0, 1, 2)
    assert main(["evaluate", str(root), "--accept", "1.0", "--format", "json"]) == 0
    assert "m11.py" in capsys.readouterr().out
    assert main(["init", str(tmp_path)]) == 0 and main(["init", str(tmp_path)]) == 1
