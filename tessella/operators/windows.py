"""Features over the ordered tokens of a page: page-wide, neighbouring, sliding and delimiter blocks.

All are generic over the partition and order columns, so they serve any ordered stream of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import share


def zscore(value: str, whole: W.WindowSpec) -> Column:
    """(value - mean) / sample deviation; the deviation of a single row counts as 1, and 0 gives 0."""
    spread = F.coalesce(F.stddev_samp(value).over(whole), F.lit(1.0))
    return share(F.col(value) - F.avg(value).over(whole), spread)


def page_features(rows: DataFrame, page: str = "page_id", order: str = "position") -> DataFrame:
    """Needs text, words, length, n_words and the parse stage's depth, block_chars and vocabulary."""
    whole, ordered = W.Window.partitionBy(page), W.Window.partitionBy(page).orderBy(order)
    same = W.Window.partitionBy(page, "text")
    low = F.array_distinct(F.transform("words", lambda w: F.lower(w)))
    # sorts that serve later windows come last: by text, then none, then by position
    rows = rows.withColumn("token_repeated_in_page", F.count("*").over(same).cast("double"))
    rows = rows.withColumns(
        {
            "total": F.count("*").over(whole),
            "max_depth": F.max("depth").over(whole),
            "chars": F.sum("length").over(whole),
            "length_spread": F.coalesce(F.stddev_samp("length").over(whole), F.lit(1.0)),
            "words_spread": F.coalesce(F.stddev_samp("n_words").over(whole), F.lit(1.0)),
            "length_zscore": zscore("length", whole),
            "n_words_zscore": zscore("n_words", whole),
            "normalized_token_length": share(F.col("length") * F.count("*").over(whole), F.sum("length").over(whole)),
        }
    )
    rows = rows.withColumns(
        {"before": F.lag("length", 1, 0.0).over(ordered), "after": F.lead("length", 1, 0.0).over(ordered), "low": low}
    )
    return rows.withColumns(
        {
            "relative_position": share(F.col(order), F.col("total") - 1),
            "relative_depth_ratio": F.when(F.col("max_depth") == 0, 0.0).otherwise(F.col("depth") + share(F.lit(1.0), F.col("max_depth"))),
            "tf_log": F.log2(F.col("token_repeated_in_page") + 1),
            "uniq_ratio": share(F.size("low"), F.col("vocabulary")),
            "neigh_len_diff": (F.abs(F.col("length") - F.col("before")) + F.abs(F.col("length") - F.col("after"))) / 2,
            "block_text_length_ratio": share(F.col("block_chars"), F.col("chars")),
            "normalized_block_area": F.when(F.col("max_depth") == 0, 0.0).otherwise(
                (share(F.col(order), F.col("total") - 1) + share(F.col("depth") + 1, F.col("max_depth"))) / 2
            ),
        }
    )


def neighbour_features(rows: DataFrame, value: str = "length", page: str = "page_id", order: str = "position") -> DataFrame:
    """Peaks and gradient of a value; a row without a neighbour has itself for one."""
    ordered = W.Window.partitionBy(page).orderBy(order)
    v = F.col(value)
    before, after = (F.coalesce(f(value, 1).over(ordered), v) for f in (F.lag, F.lead))
    rows = rows.withColumns({"_before": before, "_after": after})
    high = F.greatest("_before", "_after")
    high = F.when(high == 0, 1.0).otherwise(high)
    return rows.withColumns(
        {
            f"{value}_is_local_max": F.when((v > F.col("_before")) & (v > F.col("_after")), 1.0).otherwise(0.0),
            f"{value}_peak_prominence": F.greatest(F.lit(0.0), (v - high) / high),
            f"{value}_gradient_sign": F.signum(F.col("_after") - F.col("_before")),
        }
    ).drop("_before", "_after")


def window_features(rows: DataFrame, values: list[str], reach: int, page: str = "page_id", order: str = "position") -> DataFrame:
    """Mean and population deviation of values over ``reach`` rows to either side, fewer at the ends."""
    around = W.Window.partitionBy(page).orderBy(order).rowsBetween(-reach, reach)
    return rows.withColumns(
        {f"window_mean_{v}": F.avg(v).over(around) for v in values} | {f"window_std_{v}": F.stddev_pop(v).over(around) for v in values}
    )


def block_features(
    rows: DataFrame,
    delimiter: Column,
    keyword: Column,
    value: str = "length",
    page: str = "page_id",
    order: str = "place",
    strict: bool = False,
) -> DataFrame:
    """Features of the blocks between delimiter rows, which themselves are in no block and keep 0.

    Rank by value, largest first and earlier first among equals; distance of the value from the block's
    median in sample deviations (of a single row, 1); rows since the delimiter, or since before the first
    row; and whether the block's first keyword row is still to come. With strict, a page with a block of
    several equal values is left out.
    """
    so_far = W.Window.partitionBy(page).orderBy(order).rowsBetween(W.Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_mark": F.coalesce(delimiter, F.lit(False)), "_key": F.coalesce(keyword, F.lit(False))})
    rows = rows.withColumns(
        {
            "_block": F.sum(F.col("_mark").cast("long")).over(so_far),
            "_since": F.coalesce(F.max(F.when(F.col("_mark"), F.col(order))).over(so_far), F.lit(-1)),
        }
    )
    block = W.Window.partitionBy(page, "_block", "_mark")
    ranked = block.orderBy(F.desc(value), order)
    spread = F.stddev_samp(value).over(block)
    rows = rows.withColumns(
        {
            "_rank": F.row_number().over(ranked).cast("double"),
            "_spread": spread,
            "_median": F.median(value).over(block),
            "_first_key": F.min(F.when(F.col("_key"), F.col(order))).over(block),
        }
    )
    if strict:
        whole = W.Window.partitionBy(page)
        rows = rows.withColumn("_flat", F.max((~F.col("_mark") & (F.col("_spread") == 0)).cast("int")).over(whole)).filter("_flat = 0")
    inside = ~F.col("_mark")
    return rows.withColumns(
        {
            f"{value}_rank_in_block": F.when(inside, F.col("_rank")).otherwise(0.0),
            f"{value}_z_to_block_median": F.when(
                inside, share(F.col(value) - F.col("_median"), F.coalesce("_spread", F.lit(1.0)))
            ).otherwise(0.0),
            "dist_from_last_price_token": F.when(inside, (F.col(order) - F.col("_since")).cast("double")).otherwise(0.0),
            "is_between_price_and_locali": F.when(inside & (F.col(order) < F.col("_first_key")), 1.0).otherwise(0.0),
        }
    ).drop("_mark", "_key", "_block", "_since", "_rank", "_spread", "_median", "_first_key")
