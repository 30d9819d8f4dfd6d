"""Named transforms and their composition (X1, X2, X7, X8): plain functions from DataFrame to DataFrame."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.operators import augment, cloud, evaluate, grid, scalar

Transform = Callable[..., DataFrame]
TRANSFORMS: dict[str, Transform] = {
    "drop_classes": cloud.drop_classes, "centre_shift": cloud.centre_shift, "positive_shift": cloud.positive_shift, "unit_sphere": cloud.unit_sphere,
    "normalise_intensity": cloud.normalise_intensity, "limit_points": cloud.limit_points, "dropout": cloud.dropout, "patch": cloud.patch, "sphere_crop": cloud.sphere_crop,
    "drop_ribs": cloud.drop_ribs, "truncate_at_rib": cloud.truncate_at_rib, "flip": augment.flip, "jitter": augment.jitter, "scale_clouds": augment.scale_clouds,
    "clip": scalar.clip_points, "copy_columns": scalar.copy_columns, "set_constants": scalar.set_constants,
}


def register(name: str) -> Callable[[Transform], Transform]:
    """Add a transform under a name; a name is taken once."""

    def add(f: Transform) -> Transform:
        if name in TRANSFORMS:
            raise KeyError(f"{name} is already a transform")
        TRANSFORMS[name] = f
        return f

    return add


@register("scale")
def scale(df: DataFrame, factor: float) -> DataFrame:
    return df.withColumns({a: F.col(a) * factor for a in "xyz"})


def load_modules(names: Sequence[str]) -> None:
    """Import the user modules that a configuration names, which register their transforms. Executors need only what their
    Python functions use: ship it with SparkContext.addPyFile."""
    for name in names:
        importlib.import_module(name)


#: Metrics by name, built on the counts tp, fp, fn and tn; null where not applicable.
METRICS: dict[str, Callable[[], Column]] = {
    "iou": lambda: evaluate.ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")),
    "dice": lambda: evaluate.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
    "recall": lambda: evaluate.ratio(F.col("tp"), F.col("tp") + F.col("fn")),
    "precision": lambda: evaluate.ratio(F.col("tp"), F.col("tp") + F.col("fp")),
    "specificity": lambda: evaluate.ratio(F.col("tn"), F.col("tn") + F.col("fp")),
    "accuracy": lambda: evaluate.ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")),
}


def selected_metrics(rates: DataFrame, names: Sequence[str], ignored: Sequence[int] = ()) -> DataFrame:
    """The named metrics of each class; an unknown name is an error, ignored classes are null."""
    unknown = [n for n in names if n.lower() not in METRICS]
    if unknown:
        raise KeyError(f"unknown metrics: {unknown}")
    kept = ~F.col("class").isin(*ignored) if ignored else F.lit(True)
    return rates.withColumns({n.lower(): F.when(kept, METRICS[n.lower()]()) for n in names})


def fragment(df: DataFrame, size: float, then: Sequence[dict] = ()) -> DataFrame:
    """One cloud to many: the fragments of a grid, each a cloud of its own (fragment), with further transforms applied to
    all of them at once."""
    return compose(then)(grid.fragments(grid.cells(df, size)))


def compose(steps: Sequence[dict]) -> Callable[[DataFrame], DataFrame]:
    """Transforms from {type, arguments} in order, as one lazy plan."""
    parts = [(TRANSFORMS[s["type"]], {k: v for k, v in s.items() if k != "type"}) for s in steps]
    return lambda df: reduce(lambda d, p: p[0](d, **p[1]), parts, df)


def test_time(df: DataFrame, copies: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Augmented copies of every cloud, told apart by ``aug``."""
    out = None
    for k, f in enumerate(copies):
        part = f(df).withColumn("aug", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out
