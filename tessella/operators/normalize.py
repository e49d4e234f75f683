"""Corpus-wide z-scores: a one-row fit and a projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def numeric_columns(rows: DataFrame, exclude: tuple[str, ...] = ("position", "page_id")) -> list[str]:
    """Numeric columns but for those excluded, from the schema alone."""
    return [f.name for f in rows.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def fit_normalizer(rows: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(feature, mean, std, n): nulls are skipped; mean is 0 without values, std (sample) 0 with fewer than two."""
    features = features or numeric_columns(rows)
    wide = rows.agg(
        *[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.count(c).alias("n")).alias(c) for c in features]
    )
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in features])).alias("r"))
    zero = F.lit(0.0)
    return long.select(
        "r.feature", F.coalesce("r.x.mean", zero).alias("mean"), F.coalesce("r.x.std", zero).alias("std"), F.col("r.x.n").alias("n")
    )


def transform_normalizer(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """(x - mean) / std for each fitted feature; 0 where std is 0, null stays null. stats has a row a feature."""
    fitted = {r.feature: (r.mean, r.std) for r in stats.select("feature", "mean", "std").collect()}
    return rows.withColumns(
        {
            c: F.when(F.col(c).isNotNull(), F.lit(0.0) if std == 0 else (F.col(c) - F.lit(mean)) / F.lit(std))
            for c, (mean, std) in fitted.items()
            if c in rows.columns
        }
    )
