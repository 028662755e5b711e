"""Project configuration, corpus manifests, model registry: small files the driver reads."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import records

CONFIG_NAME = "plumbline.toml"
CLASSES = ("A", "B", "C")


@dataclass
class ProjectConfig:
    model: str | None = None
    language: str | None = None
    strict: bool = False
    exclude: list[str] = field(default_factory=list)
    accept: float | None = None
    reject: float | None = None
    rules: list[tuple[str, float | None, float | None]] = field(default_factory=list)
    overrides: dict[str, str] = field(default_factory=dict)


def _pair(t: dict) -> tuple[float | None, float | None]:
    a, r = t.get("accept"), t.get("reject")
    for v in (a, r):
        if v is not None and not 0 <= v <= 1:
            raise ValueError("thresholds lie between 0 and 1")
    if a is not None and r is not None and a >= r:
        raise ValueError("the accept threshold must be below the reject threshold")
    return a, r


def parse_config(text: str) -> ProjectConfig:
    d = tomllib.loads(text)
    known = {"model", "language", "strict", "exclude", "thresholds", "paths", "language_overrides"}
    if extra := set(d) - known:
        raise ValueError(f"unknown keys: {sorted(extra)}")
    a, r = _pair(d.get("thresholds", {}))
    rules = [(p["glob"], *_pair(p.get("thresholds", {}))) for p in d.get("paths", [])]
    return ProjectConfig(d.get("model"), d.get("language"), bool(d.get("strict", False)), list(d.get("exclude", [])), a, r, rules, dict(d.get("language_overrides", {})))


def find_config(start: str) -> str | None:
    """The nearest configuration file from ``start`` upwards."""
    at = os.path.abspath(start)
    while True:
        path = os.path.join(at, CONFIG_NAME)
        if os.path.isfile(path):
            return path
        up = os.path.dirname(at)
        if up == at:
            return None
        at = up


def load_config(start: str) -> ProjectConfig:
    path = find_config(start)
    if path is None:
        return ProjectConfig()
    with open(path, encoding="utf-8") as f:
        return parse_config(f.read())


def starter() -> str:
    return "strict = false\nexclude = []\n\n[thresholds]\naccept = 0.4\nreject = 0.6\n"


def manifest_targets(text: str) -> list[dict]:
    """Targets of a corpus manifest, checked: names are unique, patterns are not empty, the class is known."""
    d = tomllib.loads(text)
    if "corpus" not in d:
        raise ValueError("not a corpus manifest")
    c = d["corpus"]
    if c.get("class") not in CLASSES:
        raise ValueError(f"class must be one of {CLASSES}")
    out = []
    for t in d.get("target", []):
        include, exclude = t.get("include", []), t.get("exclude", [])
        if not include or not all(include) or not all(exclude) or not all(re.fullmatch(r"\S+", t.get(k, "")) for k in ("name", "url", "ref")):
            raise ValueError(f"target {t.get('name')!r} is not complete")
        out.append({"corpus": c["name"], "class": c["class"], "language": c.get("language"), "name": t["name"], "url": t["url"], "ref": t["ref"], "include": include, "exclude": exclude})
    if len({t["name"] for t in out}) != len(out):
        raise ValueError("target names repeat")
    return out


def composition_sources(text: str) -> list[str]:
    d = tomllib.loads(text)
    if "composition" not in d:
        raise ValueError("not a composition manifest")
    return list(d["composition"].get("sources", []))


def load_manifest(path: str) -> list[dict]:
    """Targets of a corpus manifest, or of all that a composition names."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if "corpus" in tomllib.loads(text):
        return manifest_targets(text)
    return [t for s in composition_sources(text) for t in load_manifest(os.path.join(os.path.dirname(path), s))]


def load_manifests(folder: str) -> tuple[list[dict], list[str]]:
    """Targets of all manifests of a folder, and the files that could not be read."""
    found, failed = [], []
    for name in sorted(os.listdir(folder)):
        if name.endswith(".toml"):
            try:
                found += load_manifest(os.path.join(folder, name))
            except (ValueError, KeyError, OSError) as e:
                failed.append(f"{name}: {e}")
    return found, failed


def targets_table(spark: SparkSession, targets: list[dict]) -> DataFrame:
    schema = "corpus string, class string, language string, name string, url string, ref string, include array<string>, exclude array<string>"
    t = spark.createDataFrame([tuple(x[k] for k in ("corpus", "class", "language", "name", "url", "ref", "include", "exclude")) for x in targets], schema)
    return t.withColumn("entry_hash", records.entry_hash(F.col("name"), F.col("url"), F.col("ref"), F.col("include"), F.col("exclude")))


def registry_entries(spark: SparkSession, text: str) -> DataFrame:
    """Models of a registry's JSON."""
    rows = [(m["name"], m.get("language"), m.get("version"), m.get("download_url"), m.get("sha256"), m.get("size_bytes")) for m in json.loads(text)["models"]]
    return spark.createDataFrame(rows, "name string, language string, version string, download_url string, sha256 string, size_bytes long")


def not_local(remote: DataFrame, local: DataFrame) -> DataFrame:
    return remote.join(local.select("name"), "name", "left_anti")


def local_models(bundled: DataFrame, cached: DataFrame) -> DataFrame:
    """Bundled and cached models; of one name the bundled."""
    return bundled.unionByName(cached.join(bundled.select("name"), "name", "left_anti"), allowMissingColumns=True)


def verified(data: bytes, sha256: str) -> bytes:
    if hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError("the model's digest differs from the registry's")
    return data


def pulled(entry: dict, cache: str, force: bool = False) -> str:
    """The path of a registry's model in the cache folder, fetched and verified if it is not there; what does not verify is not kept."""
    import urllib.request

    os.makedirs(cache, exist_ok=True)
    path = os.path.join(cache, entry["name"].replace("/", "_") + ".npz")
    if not os.path.exists(path) or force:
        url = entry["download_url"]
        with urllib.request.urlopen(url if "://" in url else f"file://{os.path.abspath(url)}", timeout=60) as f:
            data = verified(f.read(), entry["sha256"])
        with open(path + ".part", "wb") as f:
            f.write(data)
        os.replace(path + ".part", path)
    return path


def resolved(spark: SparkSession, name: str, cache: str):
    """A model by its folder, its archive, or its name in the cache."""
    from plumbline.operators import model

    if name.endswith(".npz"):
        return model.import_npz(name)
    cached = os.path.join(cache, name.replace("/", "_") + ".npz")
    return model.import_npz(cached) if not os.path.exists(name) and os.path.exists(cached) else model.load(spark, name)


def config_hash(start: str) -> str:
    """Digest of the nearest configuration file, by which caches are told apart; empty without one."""
    path = find_config(start)
    if path is None:
        return ""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
