"""Queries on parsed pages whose tree SQL knows: each nation is a page that lists its customers.

    <section id="n7"><h2 class="t title">GERMANY</h2><div class="list big">
      <p style="font-size:12px;display:block"><a href="/c/1">Customer#1</a><b>BUILDING</b> x.</p> ...
    </div></section>

without white space between the tags. So every number of the tree has a closed form in the m customers of a
nation, their names and their segments: equal segments are equal markup, in different paragraphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.fast import fast_token_features
from .operators.features import page_token_features
from .queries import query, table


def nation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.sort_array(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("people")
    )
    rows = table(spark, sf_dir, "nation").join(people, "n_nationkey", "left")
    entry = F.transform(
        F.coalesce("people", F.array().cast("array<struct<c_custkey:bigint,c_name:string,c_mktsegment:string>>")),
        lambda x: F.concat(
            F.lit('<p style="font-size:12px;display:block"><a href="/c/'), x["c_custkey"].cast("string"), F.lit('">'), x["c_name"],
            F.lit("</a><b>"), x["c_mktsegment"], F.lit("</b> x.</p>"),
        ),
    )
    html = F.concat(
        F.lit('<section id="n'), F.col("n_nationkey").cast("string"), F.lit('"><h2 class="t title">'), F.col("n_name"),
        F.lit('</h2><div class="list big">'), F.array_join(entry, ""), F.lit("</div></section>"),
    )
    return rows.select(F.col("n_nationkey").cast("long").alias("page_id"), html.alias("html"))


#: One row a customer (c), and one a nation (g): i is the place, lp the length of what a paragraph shows.
_TREE = """c0 AS (SELECT c_nationkey AS k, c_custkey, c_name AS name, c_mktsegment AS seg, length(c_name) AS la, length(c_mktsegment) AS lb,
  length(c_name) + length(c_mktsegment) + 2 AS lp, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i,
  count(*) OVER (PARTITION BY c_nationkey) AS m, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS same,
  CASE WHEN regexp_matches(c_name, '[0-9]') THEN 1 ELSE 0 END AS da, CASE WHEN regexp_matches(c_mktsegment, '[0-9]') THEN 1 ELSE 0 END AS db,
  c_name || c_mktsegment || 'x.' AS shown FROM customer),
c AS (SELECT *, lag(i) OVER s AS before, lead(i) OVER s AS after,
  last_value(la) OVER (PARTITION BY k, seg ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS la_last FROM c0 WINDOW s AS (PARTITION BY k, seg ORDER BY i)),
g AS (SELECT n_nationkey AS k, n_name AS name, length(n_name) AS ln, coalesce(max(m), 0) AS m, coalesce(sum(lp), 0) AS s, coalesce(sum(1 + same + m), 0) AS reps,
  coalesce(string_agg(shown, '' ORDER BY i), '') AS shown FROM nation LEFT JOIN c ON n_nationkey = c.k GROUP BY 1, 2, 3),
t AS (
  SELECT k, 0 AS position, 'h2' AS tag, name AS text, NULL AS i, NULL AS la, NULL AS lb, NULL AS lp, NULL AS same, NULL AS da, NULL AS db, NULL AS before, NULL AS after, NULL AS la_last, NULL AS own FROM g
  UNION ALL SELECT k, 1 + 3 * i, 'a', name, i, la, lb, lp, same, da, db, before, after, la_last, shown FROM c
  UNION ALL SELECT k, 2 + 3 * i, 'b', seg, i, la, lb, lp, same, da, db, before, after, la_last, shown FROM c
  UNION ALL SELECT k, 3 + 3 * i, 'p', 'x.', i, la, lb, lp, same, da, db, before, after, la_last, shown FROM c),
r AS (SELECT t.*, t.tag IN ('a', 'b') AS ab, g.m, g.s, g.ln, g.ln + g.s AS v, g.reps, CASE t.tag WHEN 'h2' THEN g.name || g.shown WHEN 'p' THEN g.shown ELSE t.own END AS joined FROM t JOIN g ON t.k = g.k),
w AS (SELECT *, list_transform(list_filter(string_split(joined, ' '), lambda x: x <> ''), lambda x: length(x)) AS sizes FROM r)"""


def _per_tag(h2, ab, p, b=None) -> str:
    """A value by tag; a and b have the same unless b is given."""
    return f"CASE tag WHEN 'h2' THEN {h2} WHEN 'p' THEN {p} WHEN 'b' THEN {ab if b is None else b} ELSE {ab} END"


def _over(a, b) -> str:
    return f"coalesce(({a}) / nullif(({b}), 0), 0)"


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"round(CAST({v} AS DOUBLE), 6) + 0.0 AS {k}" for k, v in columns.items())


_DOC, _SECTION, _DIV = "(1 + 3 * m) / 1", "(1 + 3 * m) / 2", "CASE WHEN m > 0 THEN 3.0 ELSE 0.0 END"
_RATES = _per_tag(f"[{_DOC}, {_SECTION}]", f"[{_DOC}, {_SECTION}, {_DIV}, 1.5]", f"[{_DOC}, {_SECTION}, {_DIV}]")
#: Features that the first variant leaves at 0.
CONSTANT = {"percentile_token_length": "0", "token_distance_to_next": "0", "token_distance_to_prev": "0"}
_SPECIAL = r"len(regexp_extract_all(joined, '[^\p{L}\p{N}\s]'))"
FIRST = {
    **CONSTANT, "n_parents": _per_tag(2, 4, 3), "n_ancestors_with_class": _per_tag(0, 1, 1), "n_ancestors_with_id": "1", "n_ancestors_div": _per_tag(0, 1, 1),
    "n_ancestors_section": "1", "has_grandparent": "1", "n_children": _per_tag(0, 0, 2), "n_descendants": _per_tag(1, 1, 5), "max_child_depth": _per_tag(0, 0, 1),
    "has_only_text_children": _per_tag(1, 1, 0), "n_siblings": _per_tag(1, 1, "m - 1"), "tag_index_among_siblings": _per_tag(0, 0, "i", 1),
    "n_siblings_with_text": _per_tag("1 + (m > 0)::INT", 2, "m"), "avg_sibling_text_length": _per_tag("v / 2", "(la + lb) / 2", "s / m"),
    "n_unique_tags_among_siblings": _per_tag(2, 2, 1), "text_density": _per_tag(0, 0, "length(text) / 2"), "has_style_attribute": _per_tag(0, 0, 1),
    "n_style_properties": _per_tag(0, 0, 2), "font_size_extracted": _per_tag(0, 0, 12), "margin_top_extracted": "0", "display_type_code": _per_tag(3, 3, 1),
    "parent_tag_token_count": _per_tag(2, 2, "m"), "n_child_tokens_with_digits": _per_tag(0, 0, "da + db"), "n_descendants_with_digits": _per_tag("regexp_matches(text, '[0-9]')::INT", "da", "da + db", "db"),
    "n_descendants_with_links": _per_tag(0, 0, 1), "n_descendants_with_buttons": "0", "n_classes": _per_tag(2, 0, 0), "class_name_length_avg": _per_tag(3, 0, 0),
    "id_name_length": "0", "dom_path_length": "1", "is_link": "(tag = 'a')::INT", "link_href_depth": "2 * (tag = 'a')::INT", "css_title_score": _per_tag(0.5, 0, 0),
    "ancestors_text_density_variance": f"list_var_pop({_RATES})", "sibling_text_density": _per_tag("s", "lb", _over("s - lp", "m - 1"), "la"),
    "block_text_token_density": _per_tag(_SECTION, 1.5, 3), "block_tag_density": _per_tag(2, "2 / 3", "m / 2"), "descendants_text_density": _per_tag(0, 0, 1.5),
    "ancestors_avg_tag_density": _per_tag("1.5", "(1 + 2 + m / 2 + 2 / 3) / 4", "(1 + 2 + m / 2) / 3"), "text_ratio_in_block": _per_tag(1, "lp / s", "s / v"),
    "tag_ratio_in_block": _per_tag("(2 + 3 * m) / (3 + 3 * m)", "2 / (3 * m)", "3 * m / (2 + 3 * m)"), "block_avg_word_length": "list_avg(sizes)",
    "block_std_word_length": "CASE WHEN len(sizes) > 1 THEN list_stddev_pop(sizes) ELSE 0 END", "block_avg_sentence_count": "(length(joined) - length(replace(joined, '.', ''))) / len(sizes)",
    "descendants_link_density": _per_tag(0, 0, 0.5), "descendants_img_density": "0", "block_special_char_density": f"{_SPECIAL} / length(joined)",
    "block_digit_density": "len(regexp_extract_all(joined, '[0-9]')) / length(joined)",
    "token_dist_to_block_mid": _per_tag("position", "abs(position - same / 2) / (1 + same)", "abs(position - (m - 1) / 2) / m"),
    "block_token_count": _per_tag("1 + 3 * m", 3, "3 * m"), "block_depth_wtd_token_den": _per_tag("1 + 3 * m", 1, "3 * m / 2"),
    "siblings_tag_density": _per_tag("m", 0, "2 * (m > 1)::INT"), "local_subtree_height": _per_tag("CASE WHEN m > 0 THEN 4 ELSE 2 END", 2, 3),
    "parent_child_ratio": _per_tag(2, "2 / 3", "m / 2"), "block_text_length_ratio": _per_tag(1, "lp / v", "s / v"),
    "local_token_rep_density": _per_tag("(1 + reps) / (1 + 3 * m)", "(1 + same + m) / 3", "reps / (3 * m)"),
    "block_avg_token_distance": _per_tag(
        0, "(coalesce(3 * (i - before) - 1, 0) + 1) / 2", "(CASE WHEN i > 0 THEN 3 ELSE 0 END + CASE WHEN i < m - 1 THEN 3 ELSE 0 END) / 2", "(1 + coalesce(3 * (after - i), 0)) / 2"
    ),
}


def _rounded(rows: DataFrame, names) -> DataFrame:
    return rows.select("page_id", "position", "tag", *[(F.round(F.col(x), 6) + F.lit(0.0)).alias(x) for x in names])


@query(f"WITH {_TREE} SELECT CAST(k AS BIGINT) AS page_id, CAST(position AS BIGINT) AS position, tag, {_select(FIRST)} FROM w")
def tree_features_of_nations(spark, sf_dir):
    """All features of the tree, by the first variant."""
    return _rounded(page_token_features(nation_pages(spark, sf_dir)), FIRST)


#: For each paragraph, sums over the tokens of its link and of all bold texts of its segment: words, marks and pair distances.
_SECOND_TREE = f"""{_TREE},
q AS (SELECT x.k, x.i, sum(abs(p.at - o.at)) AS far FROM c x
  JOIN LATERAL (SELECT 1 + 3 * x.i AS at UNION ALL SELECT 2 + 3 * y.i FROM c y WHERE y.k = x.k AND y.seg = x.seg) p ON true
  JOIN LATERAL (SELECT 1 + 3 * x.i AS at UNION ALL SELECT 2 + 3 * y.i FROM c y WHERE y.k = x.k AND y.seg = x.seg) o ON true GROUP BY 1, 2),
z AS (SELECT w.*, far, la + same * lb AS chars, (la + same * lb) / 2 AS density, last_i, (SELECT la_last + same * lb) / 2 AS density_last,
  len(regexp_extract_all(own[1:la], '[^\\p{{L}}\\p{{N}}\\s]')) + same * len(regexp_extract_all(own[la + 1:la + lb], '[^\\p{{L}}\\p{{N}}\\s]')) AS marks,
  len(regexp_extract_all(own[1:la], '[0-9]')) + same * len(regexp_extract_all(own[la + 1:la + lb], '[0-9]')) AS digits,
  (la + same * lb) / (1 + same) AS mean FROM w LEFT JOIN q ON w.k = q.k AND w.i = q.i
  LEFT JOIN (SELECT k AS lk, seg, max(i) AS last_i FROM c GROUP BY 1, 2) ON lk = w.k AND seg = own[la + 1:la + lb])"""
SECOND = {
    "n_parents": "1", "n_ancestors_with_class": FIRST["n_ancestors_with_class"], "n_ancestors_with_id": "1", "n_ancestors_div": FIRST["n_ancestors_div"],
    "n_ancestors_section": "1", "has_grandparent": "1", "n_children": _per_tag(0, 0, 2), "n_descendants": _per_tag(0, 0, 2), "max_child_depth": _per_tag(0, 0, 1),
    "has_only_text_children": _per_tag(1, 1, 0), "n_siblings": _per_tag(0, 1, "m - 1"), "tag_index_among_siblings": _per_tag(0, 0, "i", 1),
    "n_siblings_with_text": _per_tag(1, 2, "m"), "avg_sibling_text_length": _per_tag(0, "(la + lb) / 2", "CASE WHEN m > 1 THEN s / m ELSE 0 END", "(la_last + lb) / 2"),
    "n_unique_tags_among_siblings": _per_tag(1, 2, 1), "relative_depth_ratio": "2", "text_density": _per_tag(0, 0, "density"), "has_style_attribute": _per_tag(0, 0, 1),
    "n_style_properties": _per_tag(0, 0, 2), "font_size_extracted": _per_tag(0, 0, 12), "margin_top_extracted": "0", "display_type_code": _per_tag(3, 3, 1),
    "parent_tag_token_count": _per_tag(0, 2, 0), "n_child_tokens_with_digits": _per_tag(0, 0, "da + db"), "n_descendants_with_digits": _per_tag(0, 0, "da + db"),
    "n_descendants_with_links": _per_tag(0, 0, 1), "n_descendants_with_buttons": "0", "n_classes": _per_tag(2, 0, 0), "class_name_length_avg": _per_tag(3, 0, 0),
    "id_name_length": "0", "dom_path_length": _per_tag(2, 4, 3), "is_link": "(tag = 'a')::INT", "link_href_depth": "2 * (tag = 'a')::INT", "css_title_score": _per_tag(0.5, 0, 0),
    "ancestors_text_density_variance": "0", "sibling_text_density": _per_tag("ln", "(la + lb) / 2", "s / m", "(la_last + lb) / 2"),
    "block_text_token_density": _per_tag(0, 0, "density"), "block_tag_density": _per_tag(0, 0, 1), "descendants_text_density": _per_tag(0, 0, "density"),
    "ancestors_avg_tag_density": _per_tag(0, "density", 0, "density_last"), "text_ratio_in_block": _per_tag("ln", "length(text)", "length(text) / density"),
    "tag_ratio_in_block": _per_tag(1, 1, 0.5), "block_avg_word_length": _per_tag(0, 0, "mean"),
    "block_std_word_length": _per_tag(0, 0, "sqrt(((la - mean) * (la - mean) + same * (lb - mean) * (lb - mean)) / (1 + same))"), "block_avg_sentence_count": "0",
    "descendants_link_density": _per_tag(0, 0, 0.5), "descendants_img_density": "0", "block_special_char_density": _per_tag(0, 0, "marks / chars"),
    "block_digit_density": _per_tag(0, 0, "digits / chars"), "block_token_count": _per_tag(0, 0, 2), "block_depth_wtd_token_den": _per_tag(0, 0, "(1 + same) / 2"),
    "siblings_tag_density": _per_tag(0, 0, "2 * (m > 1)::INT"), "local_subtree_height": _per_tag(1, 1, 2), "parent_child_ratio": _per_tag(0, 0, "2 / m"),
    "block_text_length_ratio": _per_tag(0, 0, "density / v"), "local_token_rep_density": _per_tag(0, 0, 1),
    "block_avg_token_distance": _per_tag(0, 0, "far / ((1 + same) * (1 + same))"), "normalized_block_area": "coalesce(2 * position / nullif(3 * m, 0), 0)",
}


@query(f"WITH {_SECOND_TREE} SELECT CAST(k AS BIGINT) AS page_id, CAST(position AS BIGINT) AS position, tag, {_select(SECOND)} FROM z")
def tree_features_of_nations_fast(spark, sf_dir):
    """All features of the tree, by the second variant."""
    return _rounded(fast_token_features(nation_pages(spark, sf_dir)), SECOND)
