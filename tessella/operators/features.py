"""The hundred features of a token: names, and the plan that computes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import TITLE_WORDS, share, text_features, word_list
from .dom import parsed_tokens
from .windows import block_features, neighbour_features, page_features, window_features

#: Numeric features in the order in which records hold them.
FEATURES = (
    "length", "n_words", "avg_word_length", "n_digits", "n_uppercase", "n_periods", "n_special_chars", "n_sentences",
    "is_numeric_token", "is_mixed_alphanum", "n_parents", "n_ancestors_with_class", "n_ancestors_with_id", "n_ancestors_div",
    "n_ancestors_section", "has_grandparent", "n_children", "n_descendants", "max_child_depth", "has_only_text_children",
    "n_siblings", "tag_index_among_siblings", "n_siblings_with_text", "avg_sibling_text_length", "n_unique_tags_among_siblings",
    "relative_position", "relative_depth_ratio", "text_density", "normalized_token_length", "percentile_token_length",
    "token_distance_to_next", "token_distance_to_prev", "has_style_attribute", "n_style_properties", "font_size_extracted",
    "margin_top_extracted", "display_type_code", "parent_tag_token_count", "n_child_tokens_with_digits",
    "n_descendants_with_digits", "n_descendants_with_links", "n_descendants_with_buttons", "token_repeated_in_page", "n_classes",
    "class_name_length_avg", "id_name_length", "dom_path_length", "is_link", "link_href_depth", "css_title_score",
    "capital_ratio", "keyword_score_title", "char_entropy", "length_zscore", "n_words_zscore", "tf_log", "distinct_ratio",
    "uniq_ratio", "vowel_ratio", "cv_balance", "max_digit_run", "uniq_bigram_ratio", "neigh_len_diff", "cap_run_norm",
    "ancestors_text_density_variance", "sibling_text_density", "block_text_token_density", "block_tag_density",
    "descendants_text_density", "ancestors_avg_tag_density", "text_ratio_in_block", "tag_ratio_in_block", "block_avg_word_length",
    "block_std_word_length", "block_avg_sentence_count", "descendants_link_density", "descendants_img_density",
    "block_special_char_density", "block_digit_density", "token_dist_to_block_mid", "block_token_count",
    "block_depth_wtd_token_den", "siblings_tag_density", "local_subtree_height", "parent_child_ratio", "block_text_length_ratio",
    "local_token_rep_density", "block_avg_token_distance", "normalized_block_area", "length_is_local_max",
    "length_peak_prominence", "length_gradient_sign", "length_rank_in_block", "length_z_to_block_median",
    "dist_from_last_price_token", "is_between_price_and_locali", "window_mean_length", "window_std_length",
    "window_mean_avg_word_length", "window_std_avg_word_length",
)
#: Fields of a record that nothing sets.
NULL_FEATURES = (
    "n_lowercase", "n_punctuation", "n_commas", "n_total_ancestors", "depth_in_dom", "position_in_block", "parent_token_length", "tfidf_score",
)
#: The delimiter of blocks and the keyword within them; parameters everywhere.
DELIMITER, KEYWORD = "€", "locali"


def structure_features(size: Column) -> dict[str, Column]:
    """Features of a token's element, from the numbers of the parse stage; size is the token's length."""

    def c(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    or_one = F.greatest(c("block_depth"), F.lit(1.0))
    return {
        "n_parents": c("depth"),
        "n_ancestors_with_class": c("anc_with_class"),
        "n_ancestors_with_id": c("anc_with_id"),
        "n_ancestors_div": c("anc_div"),
        "n_ancestors_section": c("anc_section"),
        "has_grandparent": F.when(c("depth") >= 2, 1.0).otherwise(0.0),
        "n_children": c("n_child_tags"),
        "n_descendants": c("n_nodes"),
        "max_child_depth": c("height"),
        "has_only_text_children": F.when(c("n_child_tags") == 0, 1.0).otherwise(0.0),
        "n_siblings": c("n_siblings"),
        "tag_index_among_siblings": c("sibling_index"),
        "n_siblings_with_text": c("siblings_with_text"),
        "avg_sibling_text_length": c("sibling_chars"),
        "n_unique_tags_among_siblings": c("sibling_names"),
        "text_density": share(size, c("n_child_tags")),
        "has_style_attribute": c("has_style"),
        "n_style_properties": c("style_properties"),
        "font_size_extracted": c("font_size"),
        "margin_top_extracted": c("margin_top"),
        "display_type_code": c("display_code"),
        "parent_tag_token_count": c("parent_child_tags"),
        "n_child_tokens_with_digits": c("digit_children"),
        "n_descendants_with_digits": c("digit_strings"),
        "n_descendants_with_links": c("links"),
        "n_descendants_with_buttons": c("buttons"),
        "n_classes": c("n_classes"),
        "class_name_length_avg": c("class_chars"),
        "id_name_length": c("id_chars"),
        "dom_path_length": F.lit(1.0),
        "is_link": c("is_link"),
        "link_href_depth": c("href_depth"),
        "css_title_score": c("title_class"),
        "ancestors_text_density_variance": c("anc_text_variance"),
        "sibling_text_density": c("other_sibling_chars"),
        "block_text_token_density": share(c("block_strings"), c("block_child_tags")),
        "block_tag_density": share(c("block_child_tags"), c("block_depth")),
        "descendants_text_density": share(c("n_strings"), c("n_tags")),
        "ancestors_avg_tag_density": c("anc_tag_rate"),
        "text_ratio_in_block": share(c("block_chars"), c("outer_chars")),
        "tag_ratio_in_block": share(c("block_tags"), c("outer_tags")),
        "block_avg_word_length": c("block_word_mean"),
        "block_std_word_length": c("block_word_std"),
        "block_avg_sentence_count": share(c("block_periods"), c("block_words")),
        "descendants_link_density": share(c("links"), c("n_tags")),
        "descendants_img_density": share(c("images"), c("n_tags")),
        "block_special_char_density": share(c("block_special"), c("block_chars")),
        "block_digit_density": share(c("block_digits"), c("block_chars")),
        "token_dist_to_block_mid": share(F.abs(F.col("position") - (c("block_size") - 1) / 2), c("block_size")),
        "block_token_count": c("block_strings"),
        "block_depth_wtd_token_den": c("block_strings") / or_one,
        "siblings_tag_density": c("other_sibling_tags"),
        "local_subtree_height": c("block_height"),
        "parent_child_ratio": c("block_child_tags") / or_one,
        "local_token_rep_density": c("block_repeats"),
        "block_avg_token_distance": c("block_gap"),
    }


def token_features(
    tokens: DataFrame,
    delimiter: str = DELIMITER,
    keyword: str = KEYWORD,
    title_words: tuple[str, ...] = TITLE_WORDS,
    strict: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(page_id, position, text, tag, classes, path_length, *keep, *FEATURES) of rows of ``parsed_tokens``.

    One exchange by page serves every window. Where a deviation that divides is 0 the score is 0; with
    strict, rows and pages that such a division, an unreadable style number or a missing own position
    would have made fail are left out instead, before the windows over surviving tokens.
    """
    rows = tokens.filter("error is null").withColumn("words", word_list(F.col("text")))
    rows = rows.withColumns(text_features(F.col("text"), F.col("words"), title_words))
    rows = page_features(rows)
    rows = rows.withColumns({f"f_{k}": v for k, v in structure_features(F.col("length")).items()})
    if strict:
        rows = rows.filter(
            "font_size is not null and margin_top is not null and block_gap is not null and length_spread > 0 and words_spread > 0"
        )
        page = W.Window.partitionBy("page_id")
        rows = rows.withColumn("place", F.row_number().over(page.orderBy("position")) - 1)
    rows = neighbour_features(rows)
    rows = window_features(rows, ["length", "avg_word_length"], 2)
    place = "place" if strict else "position"
    rows = block_features(rows, F.col("text").contains(delimiter), F.lower("text").contains(keyword), order=place, strict=strict)
    structural = set(structure_features(F.lit(0)))
    return rows.select(
        "page_id", "position", "text", "tag", "classes", "path_length", *keep,
        *[F.col(f"f_{x}" if x in structural else x).cast("double").alias(x) for x in FEATURES],
    )


def page_token_features(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", **options) -> DataFrame:
    """Pages to token features."""
    return token_features(parsed_tokens(pages, id_column, html_column), **options)
