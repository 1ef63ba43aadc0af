"""Scaler fit and transform, per-column normaliser, outlier cap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railtempo.operators.ranks import exact_percentiles_of


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of mean and population deviation per column, nulls counted as 0; the deviation 0 becomes 1."""
    exprs = []
    for c in columns:
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        exprs += [F.avg(v).alias(f"{c}_mean"), F.stddev_pop(v).alias(f"{c}_std")]
    raw = df.agg(*exprs)
    return raw.withColumns({f"{c}_std": F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std")) for c in columns})


def scale(df: DataFrame, scaler: DataFrame, columns: list[str], suffix: str = "_scaled") -> DataFrame:
    fit = scaler.select(F.struct("*")).scalar()
    return df.withColumns({
        f"{c}{suffix}": (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - fit.getField(f"{c}_mean")) / fit.getField(f"{c}_std")
        for c in columns
    })


def fit_normaliser(df: DataFrame, columns: list[str]) -> DataFrame:
    """As the scaler, but a small constant is added to the deviation instead of replacing zero."""
    exprs = []
    for c in columns:
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        exprs += [F.avg(v).alias(f"{c}_mean"), (F.stddev_pop(v) + 1e-7).alias(f"{c}_std")]
    return df.agg(*exprs)


def cap_outliers(df: DataFrame, columns: list[str], share: float = 0.99) -> DataFrame:
    """Clip each column at its ``share`` percentile after nulls became 0."""
    filled = df.fillna(0, subset=columns)
    caps = exact_percentiles_of(filled, {c: (c, share) for c in columns}).select(F.struct("*")).scalar()
    return filled.withColumns({c: F.least(F.col(c).cast("double"), caps.getField(c)) for c in columns})
