"""Weak labels: ordered rules on texts, listing cards found in pages, and a look-up join onto tokens."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import ship, spread
from .dom import parse, visible_strings

#: Class names of listing cards and their parts.
CARD_CLASS = "nd-mediaObject__content"
PRICE_CLASS, TITLE_CLASS = "styles_in-listingCardPrice__earBq", "styles_in-listingCardTitle__Wy437"
ITEM_CLASS = "styles_in-listingCardFeatureList__item__CKRyT"
#: Labels and patterns in order of precedence; the third says whether case counts.
LABEL_RULES = (
    ("FEATURE_SUPERFICIE", r"\d+\s*(m²|mq)", False),
    ("FEATURE_LOCALI", r"\d+\s*\+?\s*local.?", False),
    ("FEATURE_BAGNI", r"(\d+|\b(un|uno|una|due|tre|quattro|cinque|sei|sette|otto|nove|dieci)\b)\s*\+?\s*bagn.?\b.*", False),
    ("FEATURE_PIANO", r"piano\s*\w+", False),
    ("FEATURE_ASCENSORE", "ascensore", False),
    ("FEATURE_BALCONE", "balcone", False),
    ("FEATURE_TERRAZZO", "terrazzo", False),
    ("FEATURE_CANTINA", "cantina", False),
    ("FEATURE_ARREDATO", "arredato", False),
    ("FEATURE_LUSSO", "lusso", False),
    ("FEATURE_PREZZO", r"(€|eur|euro)", False),
    ("FEATURE_DATA", r"\d{2}/\d{2}/\d{4}", True),
    ("FEATURE_TIPOLOGIA", "asta", False),
)
PRICE_LABEL, TITLE_LABEL, DEFAULT_LABEL = "FEATURE_PREZZO", "FEATURE_TITOLO", "O"
#: White space that is squashed in the texts of items.
SQUASHED = r"(?<![€$])\s+(?![€$])"


def rule_label(text: Column, rules=LABEL_RULES, default: str = DEFAULT_LABEL) -> Column:
    """The label of the first rule that a text matches."""
    out = None
    for label, pattern, case in rules:
        hit = (text if case else F.lower(text)).rlike(f"(?U){pattern}")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def _found(html: str) -> list[tuple[str, str]]:
    """(kind, text) of the prices, titles and items of the cards of a page."""
    nodes, found = parse(html), []
    for card in nodes:
        if card.name == "div" and CARD_CLASS in card.classes:
            inner = [x for x in nodes[card.index + 1 : card.end] if x.name is not None]
            for kind, wanted in (("price", PRICE_CLASS), ("title", TITLE_CLASS), ("item", ITEM_CLASS)):
                if kind == "title":
                    hits = [x for x in inner if x.name == "a" and wanted in x.classes][:1]
                else:
                    hits = [x for x in inner if x.name == "span" and _below(x, card, wanted)]
                    hits = hits[:1] if kind == "price" else hits
                found += [(kind, "".join(visible_strings(nodes, x))) for x in hits]
    return found


def _cards(batches):
    for batch in batches:
        rows = []
        for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                rows += [(page_id, k, kind, text, None) for k, (kind, text) in enumerate(_found(html or ""))]
            except Exception as e:  # a page that can't be read gives one row that says why
                rows.append((page_id, None, None, None, f"{type(e).__name__}: {e}"))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "place", "kind", "text", "error"])


def _below(node, card, wanted: str) -> bool:
    """Whether an ancestor of node has the class: a descendant selector may also match above the card."""
    up = node.parent
    while up is not None:
        if up.name is not None and wanted in up.classes:
            return True
        up = up.parent
    return False


def card_rows(pages: DataFrame) -> DataFrame:
    """(page_id, place, kind, text, error) of the parts of the listing cards of pages(page_id, html); a page that fails gives a row with its error."""
    ship(pages.sparkSession)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return spread(source).mapInArrow(_cards, "page_id long, place long, kind string, text string, error string")


def card_labels(pages: DataFrame) -> DataFrame:
    """(page_id, place, token, label) of every price, title and item of the listing cards; pages that fail are left out."""
    found = card_rows(pages).filter("error is null")
    squashed = F.regexp_replace("text", f"(?U){SQUASHED}", " ")
    return found.select(
        "page_id",
        "place",
        F.when(F.col("kind") == "item", squashed).otherwise(F.col("text")).alias("token"),
        F.when(F.col("kind") == "price", PRICE_LABEL).when(F.col("kind") == "title", TITLE_LABEL).otherwise(rule_label(squashed)).alias("label"),
    )


def label_map(labels: DataFrame, *order: str) -> DataFrame:
    """(key, label): for each stripped and lower-cased token the label that comes last in the order."""
    key = F.lower(strip(F.col("token"))).alias("key")
    return labels.groupBy(key).agg(F.max_by("label", F.struct(*order)).alias("label"))


def label_tokens(tokens: DataFrame, labels: DataFrame, text: str = "text", default: str = DEFAULT_LABEL) -> DataFrame:
    """tokens with the label of their text, or the default. Spark broadcasts the map if it is small enough."""
    keyed = tokens.withColumn("key", F.lower(strip(F.col(text))))
    return keyed.join(labels.select("key", "label"), "key", "left").drop("key").withColumn("label", F.coalesce("label", F.lit(default)))


def label_ids(labelled: DataFrame) -> DataFrame:
    """(label, id): ids in sorted order of the labels, from 0."""
    from pyspark.sql.window import Window

    return labelled.select("label").filter("label is not null").distinct().select(
        "label", (F.row_number().over(Window.orderBy("label")) - 1).cast("long").alias("id")
    )


def squash(text: str) -> str:
    """What ``card_labels`` does to the text of an item, for use outside Spark."""
    return re.sub(SQUASHED, " ", text)
