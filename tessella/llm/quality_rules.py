"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams, in SQL functions only.

Words and word pairs fall into BUCKETS classes by hash. Their shares among documents that pass strict
base rules (the trusted target) and among all documents (the raw corpus) are two multinomials, both
with add-one smoothing and both counted over whole texts of the whole corpus. A document's ratio is
the mean of log(target share / raw share) over its n-grams; one fixed threshold decides on it.

Neither pass shuffles text: counting partially aggregates into BUCKETS rows for each task, and scoring
looks up a constant array of BUCKETS numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 8192
#: A document with a mean log ratio below this is not kept.
THRESHOLD = -0.15
_SYMBOLS = "[#*$%&|<>]"


def word_list(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _let(value: Column, body) -> Column:
    """body of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Where the hashes of all windows differ, none repeats. Elsewhere they are sorted with their places; the
    windows whose hash a neighbour has, which are few, are then sorted by their words, and those whose words
    a neighbour has repeat. The places that they cover are counted in order, each window adding what the
    one before it has not covered.
    """

    def among_neighbours(ordered: Column, field: str) -> Column:
        return F.filter(
            ordered, lambda x, i: (F.get(ordered, i - 1)[field] == x[field]) | (F.get(ordered, i + 1)[field] == x[field])
        )

    def by_words(twice: Column) -> Column:
        return F.sort_array(F.transform(twice, lambda x: F.struct(F.slice(words, x["i"] + 1, F.lit(3)).alias("w"), x["i"].alias("i"))))

    def covered(ordered: Column) -> Column:
        return F.aggregate(
            F.sort_array(F.transform(among_neighbours(ordered, "w"), lambda x: x["i"])),
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
            lambda acc: acc["n"],
        )

    def counted(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        exact = _let(_let(placed, lambda x: by_words(among_neighbours(x, "h"))), covered)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(exact)

    starts = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return _let(F.transform(starts, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), counted)


def base_counts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with words (an array) and the base columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    with_words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), word_list(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = with_words.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def trusted() -> Column:
    """Strict rules on base columns: such documents are the target that others are compared with."""
    n = F.col("n_words")
    return (n >= 50) & (50 * F.col("n_symbols") <= n) & F.col("word_chars").between(3 * n, 12 * n) & (F.col("n_dup_lines") == 0)


def bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def ngram_buckets(words: Column) -> Column:
    """Buckets of all words and of all pairs of adjacent words."""
    pairs = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: bucket(w, F.get(words, i + 1))
    )
    return F.concat(F.transform(words, lambda w: bucket(w)), pairs)


def log_ratios(counted: DataFrame) -> list[float]:
    """The log ratio of each bucket. BUCKETS rows at most come to the driver."""
    rows = (
        counted.select(trusted().cast("long").alias("good"), F.explode(ngram_buckets(F.col("words"))).alias("b"))
        .groupBy("b")
        .agg(F.sum("good").alias("good"), F.count("*").alias("n"))
    )
    found = rows.agg(F.sum("good").alias("good"), F.sum("n").alias("n"), F.collect_list(F.struct("b", "good", "n")).alias("x"))
    from math import log

    total = found.collect()[0]
    raw, target = (total["n"] or 0) + BUCKETS, (total["good"] or 0) + BUCKETS
    out = [log(raw / target)] * BUCKETS
    for b, good, n in total["x"]:
        out[b] = log((good + 1) / target) - log((n + 1) / raw)
    return out


def quality_rules(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, the base columns, n_ngrams, log_ratio, kept) of every row of docs(doc_id, text, ...).

    A null or empty text has no words: its counts are 0, base_failed is true, log_ratio is null and kept
    false. Null doc_ids and repeated rows each come back, and count as often in the multinomials; equal
    texts have equal results. Very long texts are taken whole, as arrays of their words. Other columns are
    not read; an empty table gives no rows.
    """
    counted = base_counts(docs)
    ratios = log_ratios(counted)
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    ngrams = ngram_buckets(F.col("words"))
    total = F.aggregate(ngrams, F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    count = F.greatest(2 * F.col("n_words") - 1, F.lit(0)).cast("long")
    scored = counted.withColumn("n_ngrams", count).withColumn(
        "log_ratio", F.when(count > 0, F.try_divide(total, count.cast("double")))
    )
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_ratio") >= threshold, F.lit(False))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_ngrams", "log_ratio", kept.alias("kept"),
    )
