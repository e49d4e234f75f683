"""The second variant of the extractor: other tree, block, tie and spread rules under the same names.

Its tree is that of ``token_tree``; a block is what shares a parent element (parents of equal markup count
as one). Features of the text alone and sliding windows are those of the first variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.chars import LETTER, UPPER
from ..functions.text import count_of, share, text_features, word_list
from .dom import parsed_tokens
from .features import FEATURES
from .token_tree import TREE_NUMBERS
from .windows import neighbour_features, window_features

#: What the second variant takes for a price and for a number of rooms.
PRICE_PATTERN = r"\b\d{1,3}(?:[.,]\d{3})*(?:[.,]\d+)?\s*€\b"
ROOMS_PATTERN = r"\b\d+(?:[.,]\d+)?\s*locali?\b"
#: Numbers of the parse stage that both variants take.
SHARED_NUMBERS = (
    "anc_with_class", "anc_with_id", "anc_div", "anc_section", "n_child_tags", "font_size", "margin_top", "n_classes", "class_chars",
    "id_chars", "is_link", "href_depth", "title_class",
)


def order_features(rows: DataFrame, value: str = "length", page: str = "page_id", order: str = "position") -> DataFrame:
    """Share of values up to the own, the neighbours' values (0 where there is none), and a population z-score."""
    whole, ordered = W.Window.partitionBy(page), W.Window.partitionBy(page).orderBy(order)
    return rows.withColumns(
        {
            "percentile_token_length": F.cume_dist().over(whole.orderBy(value)),
            "token_distance_to_next": F.lead(value, 1, 0.0).over(ordered),
            "token_distance_to_prev": F.lag(value, 1, 0.0).over(ordered),
            "length_zscore": share(F.col(value) - F.avg(value).over(whole), F.stddev_pop(value).over(whole)),
        }
    )


def block_features(
    rows: DataFrame, delimiter: Column, keyword: Column, block: str = "block", value: str = "length", page: str = "page_id", order: str = "position"
) -> DataFrame:
    """Blocks are given; equal values share the smallest rank; distances are from the page's last delimiter.

    Without a delimiter in the page, the distance is 0 and nothing is between.
    """
    within, whole = W.Window.partitionBy(page, block), W.Window.partitionBy(page)
    spread = F.stddev_pop(value).over(within)
    keyed = F.when(keyword, F.col(order))
    last = F.max(F.when(delimiter, F.col(order))).over(whole)
    inside = last.isNotNull() & (F.min(keyed).over(whole) < F.col(order)) & (F.col(order) < F.max(keyed).over(whole))
    return rows.withColumns(
        {
            "length_rank_in_block": F.rank().over(within.orderBy(F.desc(value))).cast("double"),
            "length_z_to_block_median": (F.col(value) - F.median(value).over(within)) / F.when(spread == 0, 1.0).otherwise(spread),
            "dist_from_last_price_token": F.coalesce(F.abs(F.col(order) - last), F.lit(0)).cast("double"),
            "is_between_price_and_locali": F.when(inside, 1.0).otherwise(0.0),
        }
    )


def pair_distance(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Mean distance of all n * n ordered pairs of positions of a group, in one pass over sorted positions.

    No pair is made: the k-th of n sorted positions is added k times and subtracted n - 1 - k times.
    """
    group = W.Window.partitionBy(*keys)
    ranked = rows.select(*keys, order, (F.row_number().over(group.orderBy(order)) - 1).alias("_k"), F.count("*").over(group).alias("_n"))
    total = F.sum(F.col(order) * (2 * F.col("_k") - F.col("_n") + 1))
    n = F.max("_n")
    return ranked.groupBy(*keys).agg(share(2 * total, n * n).alias(name))


def block_marks(text: Column) -> tuple[Column, Column]:
    """Whether a text holds a price, and a number of rooms."""
    return tuple(F.lower(text).rlike(f"(?U){x}") for x in (PRICE_PATTERN, ROOMS_PATTERN))


def tree_features() -> dict[str, Column]:
    """Features of a token's element from the numbers of the parse stage."""

    def c(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    def or_one(value: Column) -> Column:
        return F.when(value == 0, 1.0).otherwise(value)

    below, density = c("t_descendants"), c("t_density")
    depth_ratio = share(c("t_depth") + 1, c("t_max_depth"))
    return {
        "n_parents": c("t_depth"),
        "n_ancestors_with_class": c("anc_with_class"),
        "n_ancestors_with_id": c("anc_with_id"),
        "n_ancestors_div": c("anc_div"),
        "n_ancestors_section": c("anc_section"),
        "has_grandparent": F.when(c("t_ancestors") > 1, 1.0).otherwise(0.0),
        "n_children": c("t_children"),
        "n_descendants": below,
        "max_child_depth": c("t_child_depth"),
        "has_only_text_children": F.when(c("n_child_tags") == 0, 1.0).otherwise(0.0),
        "n_siblings": c("t_siblings"),
        "tag_index_among_siblings": c("t_index"),
        "n_siblings_with_text": c("t_siblings_with_text"),
        "avg_sibling_text_length": F.when(c("t_siblings") > 0, c("t_sibling_chars")).otherwise(0.0),
        "n_unique_tags_among_siblings": c("t_sibling_names"),
        "relative_depth_ratio": depth_ratio,
        "text_density": density,
        "has_style_attribute": c("t_has_style"),
        "n_style_properties": c("t_style_segments"),
        "font_size_extracted": c("font_size"),
        "margin_top_extracted": c("margin_top"),
        "display_type_code": c("t_display"),
        "parent_tag_token_count": c("t_parent_descendants"),
        "n_child_tokens_with_digits": c("t_digit_children"),
        "n_descendants_with_digits": c("t_digit_descendants"),
        "n_descendants_with_links": c("t_links"),
        "n_descendants_with_buttons": c("t_buttons"),
        "n_classes": c("n_classes"),
        "class_name_length_avg": c("class_chars"),
        "id_name_length": c("id_chars"),
        "dom_path_length": c("t_ancestors"),
        "is_link": c("is_link"),
        "link_href_depth": c("href_depth"),
        "css_title_score": c("title_class"),
        "ancestors_text_density_variance": c("t_anc_variance"),
        "sibling_text_density": c("t_sibling_chars"),
        "block_text_token_density": density,
        "block_tag_density": below / or_one(c("t_names")),
        "descendants_text_density": density,
        "ancestors_avg_tag_density": c("t_anc_mean"),
        "text_ratio_in_block": F.col("length") / or_one(density),
        "tag_ratio_in_block": 1 / or_one(below),
        "block_avg_word_length": c("t_word_mean"),
        "block_std_word_length": c("t_word_std"),
        "block_avg_sentence_count": c("t_sentences"),
        "descendants_link_density": c("t_links") / or_one(below),
        "descendants_img_density": c("t_images") / or_one(below),
        "block_special_char_density": c("t_special"),
        "block_digit_density": c("t_digits"),
        "block_token_count": below,
        "block_depth_wtd_token_den": c("t_weighted"),
        "siblings_tag_density": c("t_sibling_children"),
        "local_subtree_height": c("t_height"),
        "parent_child_ratio": c("t_children") / or_one(c("t_parent_children")),
        "block_text_length_ratio": share(density, F.col("chars")),
        "local_token_rep_density": F.when(c("t_tokens") > 0, 1.0).otherwise(0.0),
        "block_avg_token_distance": c("t_distance"),
        "normalized_block_area": depth_ratio * F.col("relative_position"),
    }


def fast_token_features(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """(page_id, position, text, tag, *FEATURES) by the second variant's rules, as ``page_token_features`` gives them by the first's.

    Where a deviation that divides is 0 the score is 0, and a style number that can't be read is 0.
    """
    tokens = parsed_tokens(pages, id_column, html_column, (*SHARED_NUMBERS, *TREE_NUMBERS)).filter("error is null")
    rows = tokens.withColumn("words", word_list(F.col("text")))
    rows = rows.withColumns(text_features(F.col("text"), F.col("words")))
    whole, ordered = W.Window.partitionBy("page_id"), W.Window.partitionBy("page_id").orderBy("position")
    rows = rows.withColumn("token_repeated_in_page", F.count("*").over(W.Window.partitionBy("page_id", "text")).cast("double"))
    rows = rows.withColumns({"total": F.count("*").over(whole), "chars": F.sum("length").over(whole)})
    rows = order_features(rows)
    before, after = F.lag("length", 1).over(ordered), F.lead("length", 1).over(ordered)
    gaps = [F.coalesce(F.abs(F.col("length") - x), F.lit(0.0)) for x in (before, after)]
    within = W.Window.partitionBy("page_id", "t_block")
    rows = rows.withColumns(
        {
            "relative_position": share(F.col("position"), F.col("total") - 1),
            "normalized_token_length": share(F.col("length") * F.col("total"), F.col("chars")),
            "n_words_zscore": share(F.col("n_words") - F.avg("n_words").over(whole), F.stddev_pop("n_words").over(whole)),
            "tf_log": F.log2(F.col("token_repeated_in_page") + 1),
            "capital_ratio": share(count_of(F.col("text"), UPPER), count_of(F.col("text"), LETTER)),
            "uniq_ratio": share(F.size(F.array_distinct("words")), F.col("t_vocabulary")),
            "neigh_len_diff": (gaps[0] + gaps[1]) / 2,
            "_n": F.count("*").over(within),
            "_k": F.row_number().over(within.orderBy("position")) - 1,
        }
    )
    rows = neighbour_features(rows)
    rows = window_features(rows, ["length", "avg_word_length"], 2)
    rows = block_features(rows, *block_marks(F.col("text")), block="t_block")
    rows = rows.withColumn("token_dist_to_block_mid", share(F.abs(F.col("_k") - (F.col("_n") - 1) / 2), F.col("_n")))
    tree = tree_features()
    return rows.select("page_id", "position", "text", "tag", *[tree.get(x, F.col(x)).cast("double").alias(x) for x in FEATURES])
