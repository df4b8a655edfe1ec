"""Fitted models: logistic, Platt and isotonic calibration, walk-forward and for new rows.

Walk-forward calibration fits all folds together. Training rows become cells of equal
probability, once for all folds; Platt curves of all folds take one grouped sum for each
Newton step; isotonic curves pool neighbours that fall, first within ranges of probability
and then across them, as pooled blocks pool alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import logit
from ..session import ship_package, work_path

MIN_TRAIN = 500
#: Newton steps of a Platt curve; they double the digits each, so fewer would do.
STEPS = 12
_BLOCKS = "target int, lo double, hi double, w double, s double"


def interpolated(p: Column, xs: Column, ys: Column) -> Column:
    """Linear between the points of a curve, and its ends' values outside them."""
    at = F.greatest(F.size(F.filter(xs, lambda x: x <= p)), F.lit(1))
    x0, y0 = F.get(xs, at - 1), F.get(ys, at - 1)
    x1, y1 = F.coalesce(F.get(xs, at), x0), F.coalesce(F.get(ys, at), y0)
    inner = F.when((x1 > x0) & (p > x0), y0 + (p - x0) / (x1 - x0) * (y1 - y0)).otherwise(y0)
    return F.when(p.isNotNull(), inner)


@dataclass
class Calibrator:
    """A fitted curve as data: ``apply`` is a plain column expression."""

    method: str
    status: str
    n: int
    slope: float = 1.0
    intercept: float = 0.0
    xs: list[float] = field(default_factory=list)
    ys: list[float] = field(default_factory=list)

    def apply(self, p: Column) -> Column:
        if self.status != "ok" or self.method == "raw":
            return p
        if self.method == "platt":
            return 1 / (1 + F.exp(-(F.lit(self.slope) * logit(p) + F.lit(self.intercept))))
        return interpolated(p, F.array(*[F.lit(x) for x in self.xs]), F.array(*[F.lit(y) for y in self.ys]))


def _classes(df: DataFrame, y: str) -> tuple[int, int]:
    row = df.agg(F.count(F.lit(1)), F.count_distinct(y)).first()
    return row[0], row[1]


def logistic_fit(df: DataFrame, features: Sequence[str], y: str, n: int):
    """L2-regularised maximum likelihood with unit inverse strength: penalty 1/n per row."""
    ready = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df.select(*[F.col(c).cast("double") for c in features], F.col(y).cast("double").alias("_y")))
    return LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-9).fit(ready)


def logistic_predictions(train: DataFrame, test: DataFrame, features: Sequence[str], y: str, out: str = "pred", least: int = 50) -> DataFrame:
    """``test`` with a probability; NULL with features missing, or too little to train on."""
    full = train.dropna(subset=[*features, y])
    n, classes = _classes(full, y)
    if n < least or classes < 2:
        return test.withColumn(out, F.lit(None).cast("double"))
    model = logistic_fit(full, features, y, n)
    have = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in features])
    filled = test.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_f_{c}") for c in features])
    scored = model.transform(VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="_x").transform(filled))
    return scored.withColumn(out, F.when(have, vector_to_array("probability")[1])).select(*test.columns, out)


def fit_calibrator(df: DataFrame, method: str, p: str = "p", y: str = "y", min_n: int = MIN_TRAIN) -> Calibrator:
    """A fitted calibrator, or raw with the reason in its status."""
    pairs = df.select(F.col(p).cast("double").alias("p"), F.col(y).cast("double").alias("y")).dropna()
    n, classes = _classes(pairs, "y")
    if method == "raw":
        return Calibrator("raw", "ok", n)
    if n < min_n:
        return Calibrator("raw", f"raw_amostra_insuficiente (n={n})", n)
    if classes < 2:
        return Calibrator("raw", "raw_uma_classe", n)
    if method == "platt":
        model = logistic_fit(pairs.withColumn("z", logit(F.col("p"))), ["z"], "y", n)
        slope = float(model.coefficients[0])
        if slope <= 0:
            return Calibrator("raw", "raw_inclinacao_invalida", n)
        return Calibrator("platt", "ok", n, slope=slope, intercept=float(model.intercept))
    # equal probabilities pool before the fit, so its size is that of distinct values
    grouped = pairs.groupBy("p").agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    model = IsotonicRegression(featuresCol="p", labelCol="y", weightCol="w").fit(grouped)
    return Calibrator("isotonic", "ok", n, xs=[float(x) for x in model.boundaries], ys=[min(1.0, max(0.0, float(v))) for v in model.predictions])


def _training_cells(df: DataFrame, folds: Sequence[str], fold: str, p: str, y: str) -> DataFrame:
    """(target, p, n, s): for each fold after the first, rows and hits of earlier folds by probability."""
    place = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col(fold).cast("string")).cast("int") - 1
    full = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    cells = full.groupBy(place.alias("k"), F.col(p).cast("double").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    later = cells.filter(F.col("k").between(0, len(folds) - 2)).select(F.explode(F.sequence(F.col("k") + 1, F.lit(len(folds) - 1))).alias("target"), "p", "n", "s")
    return later.groupBy("target", "p").agg(F.sum("n").cast("double").alias("n"), F.sum("s").alias("s"))


def platt_fits(train: DataFrame, targets: Sequence[int], steps: int = STEPS) -> dict[int, tuple[float, float]]:
    """Slope and intercept for each target: L2 with unit inverse strength on the slope alone.

    A step is one job: the gradient and Hessian of every target, five sums each, reach the driver.
    """
    fits = {t: (0.0, 0.0) for t in targets}
    z = logit(F.col("p"))
    for _ in range(steps if targets else 0):
        of = lambda i: F.element_at(F.create_map(*[F.lit(x) for t in targets for x in (t, fits[t][i])]), F.col("target"))  # noqa: E731,B023
        hit = 1 / (1 + F.exp(-(of(0) * z + of(1))))
        spread = F.col("n") * hit * (1 - hit)
        miss = F.col("n") * hit - F.col("s")
        sums = train.groupBy("target").agg(F.sum(miss * z).alias("ga"), F.sum(miss).alias("gb"), F.sum(spread * z * z).alias("aa"), F.sum(spread * z).alias("ab"), F.sum(spread).alias("bb")).collect()
        for r in sums:
            a, b = fits[r.target]
            ga, haa = r.ga + a, r.aa + 1.0
            det = haa * r.bb - r.ab * r.ab
            if det > 0:
                fits[r.target] = (a - (r.bb * ga - r.ab * r.gb) / det, b - (haa * r.gb - r.ab * ga) / det)
    return fits


def _pool(batches):
    """Blocks in the order of (target, lo): neighbours whose means fall become one block."""
    stack: list[list[float]] = []
    target = None

    def out():
        return pd.DataFrame([(target, *b) for b in stack], columns=["target", "lo", "hi", "w", "s"]).astype({"target": np.int32})

    for batch in batches:
        for t, lo, hi, w, s in batch.itertuples(index=False):
            if t != target:
                if stack:
                    yield out()
                target, stack = t, []
            stack.append([lo, hi, w, s])
            while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
                last = stack.pop()
                stack[-1] = [stack[-1][0], last[1], stack[-1][2] + last[2], stack[-1][3] + last[3]]
    if stack:
        yield out()


def isotonic_fits(train: DataFrame) -> DataFrame:
    """(target, xs, ys): the points of each target's isotonic curve.

    Ranges of probability are pooled on their own, so what meets in a target is its blocks.
    """
    ship_package(train.sparkSession)
    blocks = train.select("target", F.col("p").alias("lo"), F.col("p").alias("hi"), F.col("n").alias("w"), "s")
    local = blocks.repartitionByRange("target", "lo").sortWithinPartitions("target", "lo").mapInPandas(_pool, _BLOCKS)
    whole = local.repartition("target").sortWithinPartitions("target", "lo").mapInPandas(_pool, _BLOCKS)
    y = F.least(F.greatest(F.col("s") / F.col("w"), F.lit(0.0)), F.lit(1.0))
    points = F.when(F.col("lo") == F.col("hi"), F.array(F.struct(F.col("lo").alias("x"), y.alias("y")))).otherwise(F.array(F.struct(F.col("lo").alias("x"), y.alias("y")), F.struct(F.col("hi").alias("x"), y.alias("y"))))
    curve = whole.select("target", F.explode(points).alias("at")).groupBy("target").agg(F.sort_array(F.collect_list("at")).alias("at"))
    return curve.select("target", F.col("at.x").alias("xs"), F.col("at.y").alias("ys"))


def walk_forward(df: DataFrame, folds: Sequence[str] | None = None, methods: Sequence[str] = ("raw", "platt", "isotonic"), fold: str = "fold", p: str = "p", y: str = "y", min_n: int = MIN_TRAIN) -> DataFrame:
    """p_<method> and status_<method>: each fold calibrated by earlier folds only; the first passes as it is.

    ``folds`` in their order (else all, sorted); rows of others are left out.
    """
    if folds is None:
        folds = sorted(str(row[0]) for row in df.select(fold).distinct().collect() if row[0] is not None)
    spark, path = df.sparkSession, work_path(df.sparkSession, "calibration-cells")
    _training_cells(df, folds, fold, p, y).write.parquet(path)
    train = spark.read.parquet(path)
    status = {t: "raw_sem_periodo_anterior" if t == 0 else "raw_amostra_insuficiente (n=0)" for t in range(len(folds))}
    for r in train.groupBy("target").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        status[r.target] = f"raw_amostra_insuficiente (n={int(r.n)})" if r.n < min_n else "raw_uma_classe" if r.s in (0.0, r.n) else "ok"
    fitted = [t for t, s in status.items() if s == "ok"]
    fits = platt_fits(train.filter(F.col("target").isin(fitted)), fitted) if "platt" in methods else {}
    target = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col(fold).cast("string")).cast("int") - 1
    rows = df.withColumn("_target", target).filter("_target >= 0")
    if "isotonic" in methods:
        curves = isotonic_fits(train.filter(F.col("target").isin(fitted))).select(F.col("target").alias("_t"), F.col("xs").alias("_xs"), F.col("ys").alias("_ys"))
        rows = rows.join(curves, F.col("_target") == F.col("_t"), "left")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_target") + 1)
    raw = F.col(p).cast("double")
    made = []
    for m in methods:
        own = dict(status)
        if m == "raw":
            own, value = {t: "ok" if t else s for t, s in status.items()}, raw
        elif m == "platt":
            own |= {t: "raw_inclinacao_invalida" for t, (slope, _) in fits.items() if slope <= 0}
            curve = 1 / (1 + F.exp(-(pick([fits.get(t, (1.0, 0.0))[0] for t in status]) * logit(raw) + pick([fits.get(t, (1.0, 0.0))[1] for t in status]))))
            value = F.when(pick(own.values()) == "ok", curve).otherwise(raw)
        else:
            value = F.when(F.col("_xs").isNotNull(), interpolated(raw, F.col("_xs"), F.col("_ys"))).otherwise(raw)
        made += [value.alias(f"p_{m}"), pick(own.values()).alias(f"status_{m}")]
    return rows.select(*df.columns, *made)


def apply_to_new(df: DataFrame, calibrators: dict[tuple, Calibrator], key: Sequence[str], p: str = "p") -> DataFrame:
    """operational_p and calibration_status by key; keys without a calibrator are 'unavailable'."""
    value, status = F.lit(None).cast("double"), F.lit("unavailable")
    for k, c in calibrators.items():
        here = reduce(lambda a, b: a & b, [F.col(n) == v for n, v in zip(key, k)])
        value, status = F.when(here, c.apply(F.col(p))).otherwise(value), F.when(here, c.status).otherwise(status)
    return df.select("*", value.alias("operational_p"), status.alias("calibration_status"))
