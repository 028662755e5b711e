"""The reference model: standardisation, PCA, calibration, exemplars, projection, attribution.

Vectors are array columns.  Per-feature moments and the covariance are sums that
combine in the tasks; the driver sees matrices of feature by feature only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import order

N_FEATURES = 69
N_SCALARS = 5
SCALAR_NAMES = ["halstead_volume", "halstead_difficulty", "halstead_effort", "cyclomatic_complexity", "cyclomatic_density"]
FLOOR = 1e-8
#: With up to so many components a projection is a native expression; beyond, matrix products over Arrow batches are faster.
NATIVE_COMPONENTS = 4


def feature_name(i: Column, scalars: int = N_SCALARS) -> Column:
    names = F.array(*map(F.lit, SCALAR_NAMES))
    return F.when(i < scalars, F.get(names, i)).otherwise(F.concat(F.lit("wl_hash_bin_"), F.lpad((i - scalars).cast("string"), 2, "0")))


@dataclass
class Model:
    mean: list[float]
    std: list[float]
    w: list[list[float]]  # features by components
    evr: list[float] = field(default_factory=list)
    sigma_drift: float = 1.0
    sigma_virtue: float = 1.0
    accept: float | None = None
    reject: float | None = None
    version: str = "1"
    corpus_hash: str = ""
    language: str | None = None
    corpus_class: str | None = None
    n_training: int = 0
    provider: str = ""
    distribution: dict[str, float] | None = None
    exemplars: list[str] = field(default_factory=list)  # texts, one a component at most

    @property
    def k(self) -> int:
        return len(self.w[0]) if self.w else 0

    def drift_limit(self) -> float:
        """Twice the root of the variance that the components leave: sum of (1 - |w_i|^2) s_i^2."""
        left = sum((1 - sum(x * x for x in row)) * s * s for row, s in zip(self.w, self.std, strict=True))
        return 2 * math.sqrt(max(left, FLOOR))


def finite(vec: Column) -> Column:
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vec, ok), F.lit(False))


def moments(df: DataFrame, vec: str, groups: list[str] | None = None) -> DataFrame:
    """(groups, pos, n, mean, std_samp, std_pop) of every feature."""
    g = groups or []
    return df.select(*g, F.posexplode(vec).alias("pos", "v")).groupBy(*g, "pos").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std_samp"), F.stddev_pop("v").alias("std_pop")
    )


def standard(df: DataFrame, vec: str) -> tuple[list[float], list[float]]:
    """Means and sample deviations; a deviation under 1e-10 counts as 1."""
    rows = sorted(moments(df, vec).collect(), key=lambda r: r["pos"])  # one row a feature
    return [float(r["mean"]) for r in rows], [float(r["std_samp"]) if r["std_samp"] >= 1e-10 else 1.0 for r in rows]


def _literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def standardised(vec: Column, mean: list[float], std: list[float]) -> Column:
    return F.transform(F.arrays_zip(vec.alias("x"), _literal(mean).alias("m"), _literal(std).alias("s")), lambda z: (z["x"].cast("double") - z["m"]) / z["s"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def _matrix_udf(m: Model):
    """Projection of whole batches by matrix products."""
    mean, std, w = np.array(m.mean), np.array(m.std), np.array(m.w)

    @F.pandas_udf("x_norm array<double>, z array<double>, x_rec array<double>, l_drift double, l_virtue double")
    def run(v: pd.Series) -> pd.DataFrame:
        x = (np.stack(v.to_numpy()) - mean) / std if len(v) else np.zeros((0, len(mean)))
        z = x @ w
        rec = z @ w.T
        return pd.DataFrame({"x_norm": list(x), "z": list(z), "x_rec": list(rec), "l_drift": np.linalg.norm(rec - x, axis=1), "l_virtue": np.linalg.norm(z, axis=1)})

    return run


def project(df: DataFrame, vec: str, m: Model, partial: Column | None = None) -> DataFrame:
    """Add x_norm, z, x_rec, l_drift, l_virtue, quality_flag."""
    if m.k > NATIVE_COMPONENTS:
        out = df.withColumn("_p", _matrix_udf(m)(F.col(vec).cast("array<double>"))).select("*", "_p.*").drop("_p")
    else:
        out = df.withColumn("x_norm", standardised(F.col(vec), m.mean, m.std))
        columns = [[row[j] for row in m.w] for j in range(m.k)]
        out = out.withColumn("z", F.array(*[dot(F.col("x_norm"), _literal(c)) for c in columns]))
        out = out.withColumn("x_rec", F.transform(F.array(*[_literal(row) for row in m.w]), lambda row: dot(row, F.col("z"))))
        out = out.withColumn("l_drift", norm(F.zip_with("x_rec", "x_norm", lambda a, b: a - b))).withColumn("l_virtue", norm(F.col("z")))
    flag = F.when(partial, "partial_input") if partial is not None else F.when(F.lit(False), "")
    return out.withColumn("quality_flag", flag.when(F.col("l_drift") > m.drift_limit(), "high_drift").otherwise("nominal"))


def contributions(df: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """(key, dimension, feature_index, contribution, x_norm) of a projected table: drift is x_rec - x_norm, alignment is x_rec."""
    each = F.transform(F.arrays_zip("x_rec", "x_norm"), lambda p: F.struct((p["x_rec"] - p["x_norm"]).alias("drift"), p["x_rec"].alias("align"), p["x_norm"].alias("x")))
    rows = df.select(key, *(keep or []), F.posexplode(each).alias("feature_index", "p"))
    two = F.explode(F.array(F.struct(F.lit("manifold_drift").alias("dimension"), F.col("p.drift").alias("contribution")), F.struct(F.lit("manifold_alignment").alias("dimension"), F.col("p.align").alias("contribution"))))
    return rows.select(key, *(keep or []), "feature_index", F.col("p.x").alias("x_norm"), two.alias("d")).select(key, *(keep or []), "d.dimension", "feature_index", "d.contribution", "x_norm")


def top_features(rows: DataFrame, key: str, top: int, digits: int = 9) -> DataFrame:
    """The ``top`` features of each row and dimension by absolute contribution, ties to the higher index."""
    w = Window.partitionBy(key, "dimension").orderBy(F.round(F.abs("contribution"), digits).desc(), F.col("feature_index").desc())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def gram(df: DataFrame, vec: str, mean: list[float], std: list[float]) -> tuple[int, np.ndarray]:
    """Rows and the product sum of standardised vectors: one partial matrix a task, added up by Spark."""
    d = len(mean)

    def part(batches):
        total, n = np.zeros((d, d)), 0
        for b in batches:
            if len(b):
                x = (np.stack(b["v"].to_numpy()).astype(float) - mean) / std
                total, n = total + x.T @ x, n + len(x)
        yield pd.DataFrame({"i": np.repeat(np.arange(d), d), "j": np.tile(np.arange(d), d), "s": total.ravel(), "n": n})

    rows = df.select(F.col(vec).alias("v")).mapInPandas(part, "i int, j int, s double, n long").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # features squared
    out = np.zeros((d, d))
    for r in rows:
        out[r["i"], r["j"]] = r["s"]
    return int(rows[0]["n"]) if rows else 0, out


def pca(df: DataFrame, vec: str, k: int | None = None, share: float = 0.90) -> Model:
    """Components by the eigenvectors of the covariance; the element of largest size of each is positive; as many as explain ``share``."""
    clean = df.where(finite(F.col(vec)))
    mean, std = standard(clean, vec)
    n, g = gram(clean, vec, mean, std)
    if n < 2:
        raise ValueError("a model needs two vectors or more")
    values, vectors = np.linalg.eigh(g / (n - 1))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    for j in range(vectors.shape[1]):
        if vectors[np.argmax(np.abs(vectors[:, j])), j] < 0:
            vectors[:, j] *= -1
    evr = values / values.sum() if values.sum() > 0 else values
    most = min(n - 1, len(mean))
    if k is None:
        k = min(int(np.searchsorted(np.cumsum(evr), share - 1e-12) + 1), most)
    elif k >= min(n, len(mean)):
        raise ValueError(f"{k} components need more than {k} vectors and features")
    return Model(mean, std, vectors[:, :k].tolist(), evr[:k].tolist(), n_training=n)


def calibrate(df: DataFrame, vec: str, m: Model) -> Model:
    """95th percentiles of both distances, no less than FLOOR."""
    p = project(df.where(finite(F.col(vec))), vec, m).select("l_drift", "l_virtue").persist()
    drift, virtue = (order.percentiles(p, c, {"p": 0.95}).first()["p"] for c in ("l_drift", "l_virtue"))
    p.unpersist()
    m.sigma_drift, m.sigma_virtue = max(float(drift), FLOOR), max(float(virtue), FLOOR)
    return m


def medoids(projected: DataFrame, key: str) -> DataFrame:
    """(cluster, key, distance): of the rows whose largest component is ``cluster``, the one nearest to their mean; ties to the smaller key."""
    absolute = F.transform("z", lambda x: F.abs(x))
    rows = projected.select(key, "z", (F.array_position(absolute, F.array_max(absolute)) - 1).cast("int").alias("cluster"))
    center = rows.select("cluster", F.posexplode("z").alias("pos", "v")).groupBy("cluster", "pos").agg(F.avg("v").alias("c"))
    center = center.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]).alias("center"))  # one row a component
    near = rows.join(F.broadcast(center), "cluster").withColumn("distance", norm(F.zip_with("z", "center", lambda a, b: a - b)))
    best = near.groupBy("cluster").agg(F.min(F.struct(F.round("distance", 9).alias("d"), F.col(key).alias("k"))).alias("b"))
    return best.select("cluster", F.col("b.k").alias(key), F.col("b.d").alias("distance"))


def diversity(df: DataFrame, vec: str, label: str) -> dict:
    """Effective rank, dead features, centroid distances, between-group share of the variance and balance.  Groups' centroids come to the driver: as many as there are labels."""
    m = sorted(moments(df, vec).collect(), key=lambda r: r["pos"])
    mean, pop = np.array([r["mean"] for r in m]), np.array([r["std_pop"] for r in m])
    safe = np.where(pop > 1e-12, pop, 1.0)
    n, g = gram(df, vec, mean.tolist(), safe.tolist())
    values = np.maximum(np.linalg.eigvalsh(g)[::-1], 0)
    evr = values[values > 0] / values.sum() if values.sum() > 0 else np.zeros(0)
    groups = sorted(moments(df, vec, [label]).collect(), key=lambda r: (str(r[label]), r["pos"]))
    names = list(dict.fromkeys(r[label] for r in groups))
    if len(names) < 2:
        raise ValueError("diversity needs two groups or more")
    cent = {x: (np.array([r["mean"] for r in groups if r[label] == x]) - mean) / safe for x in names}
    count = {x: next(r["n"] for r in groups if r[label] == x) for x in names}
    dist = [float(np.linalg.norm(cent[a] - cent[b])) for i, a in enumerate(names) for b in names[i + 1 :]]
    total = float((pop / safe) ** 2 @ np.ones(len(pop)))
    between = float(sum(count[x] * (cent[x] ** 2).sum() for x in names) / n)
    return {
        "n_repos": len(names), "n_vectors": n, "n_features": len(mean), "effective_rank": float(np.exp(-(evr * np.log(evr)).sum())) if len(evr) else 0.0,
        "dead_features": int((pop < 1e-6).sum()), "explained_variance_top3": [float(x) for x in evr[:3]], "min_centroid_distance": min(dist), "mean_centroid_distance": float(np.mean(dist)),
        "between_repo_variance_ratio": between / total if total > 0 else 0.0, "sample_balance": min(count.values()) / max(count.values()),
    }


def synthetic(k: int = 3, seed: int = 42, features: int = N_FEATURES) -> Model:
    """A model with orthonormal random components, zero means and unit deviations."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, k)))
    return Model([0.0] * features, [1.0] * features, q.tolist(), [1 / k] * k, version="synthetic", provider="synthetic")


def save(m: Model, spark: SparkSession, path: str, force: bool = False) -> None:
    """One row of Parquet; an existing model stays unless ``force``."""
    row = pd.DataFrame([{k: v for k, v in m.__dict__.items() if k != "distribution"} | {"distribution": m.distribution or {}}])
    schema = (
        "mean array<double>, std array<double>, w array<array<double>>, evr array<double>, sigma_drift double, sigma_virtue double, accept double, reject double, version string, corpus_hash string, "
        "language string, corpus_class string, n_training long, provider string, distribution map<string,double>, exemplars array<string>"
    )
    spark.createDataFrame(row.to_dict("records"), schema).coalesce(1).write.mode("overwrite" if force else "error").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    r = spark.read.parquet(path).first().asDict(recursive=True)
    return Model(**{k: v for k, v in r.items() if k in Model.__dataclass_fields__ and (k != "exemplars" or v is not None)})


def import_npz(path: str) -> Model:
    """A model from a numpy archive of plain arrays; pickled content is refused."""
    z = np.load(path, allow_pickle=False)
    get = lambda k, d=None: z[k] if k in z.files else d
    number = lambda k, d: float(get(k)) if get(k) is not None and np.isfinite(get(k)) else d
    return Model(
        z["mean"].tolist(), z["std"].tolist(), z["projection_matrix"].tolist(), np.asarray(get("explained_variance_ratio", [])).tolist(), number("sigma_drift", 1.0), number("sigma_virtue", 1.0),
        number("calibrated_accept", None), number("calibrated_reject", None), str(get("version", "1")), str(get("corpus_hash", "")),
    )


def inspect(m: Model) -> dict:
    return {
        "n_components": m.k, "mean_range": [min(m.mean), max(m.mean)], "std_range": [min(m.std), max(m.std)], "explained_variance": sum(m.evr), "sigma_drift": m.sigma_drift, "sigma_virtue": m.sigma_virtue,
        "accept": m.accept, "reject": m.reject, "version": m.version, "corpus_hash": m.corpus_hash, "language": m.language, "n_training": m.n_training, "provider": m.provider, "exemplars": len(m.exemplars),
    }
