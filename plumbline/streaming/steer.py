"""Feedback control of sampling temperature and top-p, per session.

A session's state is its filtered error, its integral, and the two settings.  In batch
form a session is folded in the order of its steps; in streaming form the same four
numbers are kept between micro-batches.  Steps of one session depend on each other, so
a session is one task's work; sessions are spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class PID:
    kp: float = 0.3
    ki: float = 0.05
    kd: float = 0.1
    alpha: float = 0.2
    i_max: float = 5.0
    gamma_tau: float = 0.1
    gamma_p: float = 0.05
    tau_min: float = 0.1
    tau_max: float = 1.5
    p_min: float = 0.1
    p_max: float = 0.99
    tau: float = 0.7
    p: float = 0.9

    def __post_init__(self):
        if min(self.kp, self.ki, self.kd, self.i_max, self.gamma_tau, self.gamma_p) < 0:
            raise ValueError("gains, rates and the integral's bound must not be negative")
        if not 0 < self.alpha <= 1:
            raise ValueError("alpha must be over 0 and at most 1")
        if self.tau_min >= self.tau_max or self.p_min >= self.p_max:
            raise ValueError("bounds must be in order")

    def step(self, state: tuple[float, float, float, float], error: float) -> tuple[tuple[float, float, float, float], float]:
        """(filtered, integral, tau, p) and the error to the next state and the control output."""
        filtered, integral, tau, p = state
        smooth = self.alpha * error + (1 - self.alpha) * filtered
        total = max(-self.i_max, min(self.i_max, integral + error)) if self.i_max > 0 else 0.0
        u = self.kp * error + self.ki * total + self.kd * (smooth - filtered)
        tau = max(self.tau_min, min(self.tau_max, tau - self.gamma_tau * u))
        p = max(self.p_min, min(self.p_max, p - self.gamma_p * u))
        return (smooth, total, tau, p), u


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def fold(steps: DataFrame, session: str, order: str, error: str, cfg: PID = PID()) -> DataFrame:  # noqa: B008
    """(session, order, error, u, tau, p) of every step, folded in the order of ``order`` by one expression a session."""
    rows = steps.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(error).cast("double").alias("e")))).alias("_steps"))
    item = "struct<at:{},e:double,u:double,f:double,i:double,tau:double,p:double>".format(dict(steps.dtypes)[order])
    start = F.array().cast(f"array<{item}>")

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        get = lambda k, v: F.coalesce(last[k], F.lit(v))
        f = cfg.alpha * x["e"] + (1 - cfg.alpha) * get("f", 0.0)
        i = _clamp(get("i", 0.0) + x["e"], -cfg.i_max, cfg.i_max) if cfg.i_max > 0 else F.lit(0.0)
        u = cfg.kp * x["e"] + cfg.ki * i + cfg.kd * (f - get("f", 0.0))
        new = F.struct(
            x["at"].alias("at"), x["e"].alias("e"), u.alias("u"), f.alias("f"), i.alias("i"),
            _clamp(get("tau", cfg.tau) - cfg.gamma_tau * u, cfg.tau_min, cfg.tau_max).alias("tau"), _clamp(get("p", cfg.p) - cfg.gamma_p * u, cfg.p_min, cfg.p_max).alias("p"),
        )
        return F.concat(done, F.array(new))

    folded = rows.select(session, F.explode(F.aggregate("_steps", start, step)).alias("_s"))
    return folded.select(session, F.col("_s.at").alias(order), F.col("_s.e").alias(error), F.col("_s.u").alias("u"), F.col("_s.tau").alias("tau"), F.col("_s.p").alias("p"))


def stream(steps: DataFrame, session: str, order: str, error: str, cfg: PID = PID()) -> DataFrame:  # noqa: B008
    """The same over a stream: state is kept by session; within a micro-batch steps are taken in the order of ``order``."""
    types = {f.name: f.dataType for f in steps.schema.fields}
    out = T.StructType([T.StructField(session, types[session]), T.StructField(order, types[order]), *[T.StructField(c, T.DoubleType()) for c in (error, "u", "tau", "p")]])
    held = T.StructType([T.StructField(c, T.DoubleType()) for c in ("f", "i", "tau", "p")])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (0.0, 0.0, cfg.tau, cfg.p)
        rows = pd.concat(list(batches)).sort_values([order, error], kind="stable")
        made = []
        for at, e in zip(rows[order], rows[error].astype(float), strict=True):
            now, u = cfg.step(now, e)
            made.append((key[0], at, e, u, now[2], now[3]))
        state.update(now)
        yield pd.DataFrame(made, columns=[f.name for f in out.fields])

    return steps.groupBy(session).applyInPandasWithState(run, out, held, "append", "NoTimeout")
