"""From metrics to a loss in [0, 1], a decision, violations and percentiles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring model.
DIMENSIONS = ["manifold_drift", "manifold_alignment", "token_entropy", "compression_structure", "ncd_exemplar_distance"]
#: Weights by (projection known, exemplars known).
WEIGHTS = {
    (True, True): [0.30, 0.30, 0.15, 0.15, 0.10],
    (True, False): [0.35, 0.35, 0.15, 0.15, 0.00],
    (False, True): [0.00, 0.00, 0.30, 0.30, 0.40],
    (False, False): [0.00, 0.00, 0.50, 0.50, 0.00],
}
ACCEPT, REJECT = 0.4, 0.6
DECLARATION_DAMPING = 0.5
DOMINANT_RATIO = 0.6
PERCENTILE_KNOTS = [("min", 0.0), ("p10", 10.0), ("p25", 25.0), ("median", 50.0), ("p75", 75.0), ("p90", 90.0), ("max", 100.0)]
KNOT_SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def entropy_loss(entropy: Column) -> Column:
    """High byte entropy is dense text: the loss is what is missing of 8 bits."""
    return clamp(1 - entropy / 8.0)


def decision(score: Column, accept: Column | float = ACCEPT, reject: Column | float = REJECT) -> Column:
    """Strict on both sides: below accept, above reject, else warn."""
    return F.when(score < accept, "accept").when(score > reject, "reject").otherwise("warn")


def assessment(score: Column) -> Column:
    """The critic's own label, whose bounds are inclusive."""
    return F.when(score >= REJECT, "reject").when(score >= ACCEPT, "marginal").otherwise("accept")


def resolved(explicit: Column, calibrated: Column, default: float) -> Column:
    """Threshold precedence: explicit, then the model's, then the default."""
    return F.coalesce(explicit, calibrated, F.lit(default))


def overridden(current: Column, score: Column, accept: Column, reject: Column) -> Column:
    """Decision after the fact by thresholds of which either may be null; if neither settles it, a full pair means warn, half a pair leaves it."""
    return (
        F.when(reject.isNotNull() & (score > reject), "reject")
        .when(accept.isNotNull() & (score < accept), "accept")
        .when(accept.isNotNull() & reject.isNotNull(), "warn")
        .otherwise(current)
    )


def overridden_inclusive(current: Column, score: Column, accept: Column, reject: Column) -> Column:
    """The pre-commit variant, whose bounds are inclusive."""
    return F.when(score >= reject, "reject").when(score <= accept, "accept").when(accept.isNotNull() & reject.isNotNull(), "warn").otherwise(current)


def exit_code(rejects: Column, warns: Column, strict: bool = False, lenient: bool = False) -> Column:
    """2 if anything is rejected, 1 if anything is warned of, else 0; strict counts warnings as rejections, else lenient forgives them."""
    of_warnings = 2 if strict else 0 if lenient else 1
    return F.when(rejects > 0, 2).when(warns > 0, of_warnings).otherwise(0)


def overall(rejects: Column, warns: Column) -> Column:
    return F.when(rejects > 0, "reject").when(warns > 0, "warn").otherwise("accept")


def weight(i: int, projected: Column, exemplars: Column) -> Column:
    """Weight of dimension ``i`` given what is known of the row."""
    return (
        F.when(projected & exemplars, WEIGHTS[True, True][i])
        .when(projected, WEIGHTS[True, False][i])
        .when(exemplars, WEIGHTS[False, True][i])
        .otherwise(WEIGHTS[False, False][i])
    )


def dimensions(drift: Column, virtue: Column, entropy: Column, order: Column, ncd: Column, sigma_drift: float, sigma_virtue: float) -> Column:
    """Array of (dimension, order of listing, norm, weight); null drift means no projection, null ncd no exemplars."""
    known, near = drift.isNotNull(), ncd.isNotNull()
    norms = [
        F.coalesce(F.least(drift / sigma_drift, F.lit(1.0)), F.lit(0.0)),
        F.coalesce(F.least(virtue / sigma_virtue, F.lit(1.0)), F.lit(0.0)),
        entropy_loss(entropy),
        order,
        F.coalesce(ncd, F.lit(0.0)),
    ]
    return F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.lit(i).alias("place"), norms[i].alias("norm"), weight(i, known, near).alias("weight")) for i, d in enumerate(DIMENSIONS)
    ])


def loss(dims: Column) -> Column:
    return clamp(F.aggregate(dims, F.lit(0.0), lambda a, d: a + d["norm"] * d["weight"]))


def damped(dims: Column) -> Column:
    """Declarations say little by their shape: both manifold dimensions count half."""
    half = lambda d: F.when(d["place"] < 2, d["norm"] * DECLARATION_DAMPING).otherwise(d["norm"])
    return F.transform(dims, lambda d: F.struct(d["dimension"].alias("dimension"), d["place"].alias("place"), half(d).alias("norm"), d["weight"].alias("weight")))


def damped_loss(dims: Column, dominant: Column, accept: float = ACCEPT) -> Column:
    """Loss of a file; one dominated by declarations is damped, and never below the accept threshold."""
    return F.when(dominant, F.greatest(loss(damped(dims)), F.lit(accept))).otherwise(loss(dims))


def violations(dims: Column, total: Column, top: int) -> Column:
    """The ``top`` dimensions by share of the loss, ties in the order of listing; none if the loss is 0."""
    shares = F.transform(
        F.filter(dims, lambda d: d["weight"] > 0),
        lambda d: F.struct(F.try_divide(-(d["norm"] * d["weight"]), total).alias("key"), d["place"].alias("place"), d["dimension"].alias("dimension"), d["norm"].alias("norm"),
                           F.try_divide(d["norm"] * d["weight"], total).alias("share"), (d["norm"] * d["weight"]).alias("weighted")),
    )
    return F.when(total > 0, F.slice(F.array_sort(shares), 1, top)).otherwise(F.slice(F.array_sort(shares), 1, 0))


def quality_percentile(score: Column, knots: dict[str, Column]) -> Column:
    """100 less the loss's place among the seven knots, linear between them; 50 if they are all one; at repeated knots the last counts."""
    x = [knots[k] for k, _ in PERCENTILE_KNOTS]
    y = [v for _, v in PERCENTILE_KNOTS]
    inner = F.lit(0.0)
    for i in range(6):
        inner = F.when((score >= x[i]) & (score < x[i + 1]), y[i] + (score - x[i]) / (x[i + 1] - x[i]) * (y[i + 1] - y[i])).otherwise(inner)
    place = F.when(score >= x[6], 100.0).when(score < x[0], 0.0).otherwise(inner)
    return F.when(x[0] == x[6], F.lit(50.0)).otherwise(100.0 - place)


def signal(d: Column) -> Column:
    """How much an effect size says."""
    a = F.abs(d)
    return F.when(a > 0.8, "strong").when(a > 0.5, "medium").when(a > 0.2, "weak").otherwise("noise")
