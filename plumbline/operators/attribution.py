"""Attribution of a loss to features, and directives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.model import N_SCALARS

# Fixed values of the directive vocabulary.
DIRECT_CATEGORY = {
    "token_entropy": "review_token_distribution",
    "compression_structure": "improve_compression",
    "ncd_exemplar_distance": "review_structure",
}
SIZE_SENSITIVE = ["compression_structure", "ncd_exemplar_distance"]
SMALL_LINES, HIGH, MEDIUM = 80, 0.7, 0.5


def severity(score: Column, dimension: Column, line_count: Column) -> Column:
    """By the dimension's norm; dimensions that small files distort stay medium in files of up to 80 lines."""
    s = F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")
    small = dimension.isin(SIZE_SENSITIVE) & F.coalesce(line_count <= SMALL_LINES, F.lit(False))
    return F.when(small & (s == "high"), "medium").otherwise(s)


def category(dimension: Column, feature: Column, deviation: Column, dominant: Column, scalars: int = N_SCALARS) -> Column:
    """Scalars ask for less complexity; a hash bin above its mean for extraction (unless declarations dominate), else for a review; text dimensions have one category each."""
    direct = F.element_at(F.create_map(*[F.lit(x) for kv in DIRECT_CATEGORY.items() for x in kv]), dimension)
    repeated = (deviation > 0) & ~F.coalesce(dominant, F.lit(False))
    of_feature = F.when(feature.isNull(), "review_structure").when(feature < scalars, "reduce_complexity").when(repeated, "extract_repeated_logic").otherwise("review_structure")
    return F.when(feature.isNull(), F.coalesce(direct, F.lit("review_structure"))).otherwise(of_feature)


def directives(rows: DataFrame, threshold: float = 0.3, scalars: int = N_SCALARS) -> DataFrame:
    """Keep dimensions that are available and over the threshold; ``rows`` has dimension, norm, available, feature_index, deviation, line_count, dominant."""
    c = F.col
    over = rows.where(c("available") & (c("norm") > threshold))
    return over.withColumns({
        "category": category(c("dimension"), c("feature_index"), c("deviation"), c("dominant"), scalars),
        "severity": severity(c("norm"), c("dimension"), c("line_count")),
    })


def attributions(evaluated: DataFrame, projected: DataFrame | None, key: str, first_units: DataFrame | None = None, top: int = 3) -> DataFrame:
    """A row a file and dimension, in the order of the dimensions: norm, weight, available, features of the manifold dimensions, and the place in the source.

    ``evaluated`` has the dimensions array; ``projected`` x_rec and x_norm by key; ``first_units`` the unit that was projected.
    """
    from plumbline.operators.model import contributions, feature_name, top_features

    rows = evaluated.select(key, F.explode("dimensions").alias("d")).select(key, "d.dimension", "d.place", "d.norm", "d.weight")
    if projected is None:
        out = rows.withColumn("features", F.array().cast("array<struct<rank:int,feature_index:int,feature:string,contribution:double,deviation:double>>"))
    else:
        best = top_features(contributions(projected, key), key, top)
        item = F.struct("rank", "feature_index", feature_name(F.col("feature_index")).alias("feature"), "contribution", F.col("x_norm").alias("deviation"))
        out = rows.join(best.groupBy(key, "dimension").agg(F.array_sort(F.collect_list(item)).alias("features")), [key, "dimension"], "left")  # ``top`` a group
        out = out.withColumn("features", F.coalesce("features", F.array()))
    out = out.withColumn("available", F.col("weight") > 0)
    if first_units is not None:
        out = out.join(first_units.select(key, F.col("name").alias("unit"), "start_line", "end_line"), key, "left")
    return out.orderBy(key, "place")


def to_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, attribution): the five dimensions of each file as one JSON text."""
    item = F.struct("place", *[c for c in rows.columns if c not in (key, "place")])
    return rows.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("attribution"))  # five a file


def annotation_template(found: DataFrame, key: str) -> DataFrame:
    """A row a directive to be rated by hand."""
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy(key).orderBy("dimension", "category")) - 1
    null = F.lit(None).cast("string")
    return found.select(key, index.alias("directive_index"), "category", null.alias("rating"), null.alias("rater"))


def of_files(files: DataFrame, evaluated: DataFrame, key: str, model=None, threshold: float = 0.3) -> DataFrame:
    """Directives of evaluated files: each dimension over the threshold, with the feature that says most and the lines of the first unit."""
    from plumbline.functions.lines import line_count
    from plumbline.operators import code
    from plumbline.operators.model import project

    first = code.unit_table(files, key).where("unit_idx = 0")
    projected = project(first, "features", model, F.col("partial_parse")) if model is not None else None
    rows = attributions(evaluated, projected, key, first, 1).join(evaluated.select(key, F.col("is_dominant").alias("dominant")), key)
    rows = rows.join(files.select(key, line_count(F.col("source")).alias("line_count")), key)
    feature = F.get("features", F.lit(0))
    return directives(rows.withColumn("feature_index", feature["feature_index"]).withColumn("deviation", feature["deviation"]), threshold)
