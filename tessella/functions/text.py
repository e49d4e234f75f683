"""Features of a token's own text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import ALNUM, CAPITALS, DIGIT, LETTER, LOWER, SPACE, UPPER, VOWELS

#: Words of listing titles; a parameter everywhere.
TITLE_WORDS = ("via", "trilocale", "bilocale", "appartamento")


def strip(text: Column) -> Column:
    """str.strip()"""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def word_list(text: Column) -> Column:
    """str.split()"""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def share(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def count_of(text: Column, members: str) -> Column:
    """Characters of a class."""
    return F.regexp_count(text, F.lit(f"[{members}]"))


def longest(text: Column, pattern: str) -> Column:
    """Length of the longest match, 0 if there is none."""
    return F.aggregate(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(0), lambda best, m: F.greatest(best, F.length(m))
    )


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def char_entropy(text: Column) -> Column:
    """Shannon entropy (log2) of the characters, from run lengths of the sorted characters."""
    letters = F.array_sort(F.split(text, ""))
    size = F.length(text).cast("double")

    def folded(chars: Column) -> Column:
        starts = F.filter(
            F.transform(chars, lambda c, i: F.when((i == 0) | (c != F.get(chars, i - 1)), i)), lambda i: i.isNotNull()
        )
        counts = F.transform(starts, lambda s, k: F.coalesce(F.get(starts, k + 1), F.size(chars)) - s)
        return F.aggregate(counts, F.lit(0.0), lambda acc, n: acc - n / size * F.log2(n / size))

    return F.transform(F.array(letters), folded)[0]


def text_features(text: Column, words: Column, title_words: tuple[str, ...] = TITLE_WORDS) -> dict[str, Column]:
    """The features that depend on a token's text alone; words is ``word_list(text)``."""
    size, n = F.length(text).cast("double"), F.size(words).cast("double")
    upper, lower = count_of(text, UPPER), count_of(text, LOWER)
    low = F.lower(text)
    vowels = count_of(low, VOWELS)
    letters = count_of(low, LETTER)
    bigrams = F.when(
        size >= 2, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    )
    title = F.size(F.filter(words, lambda w: F.lower(w).isin(*title_words)))
    return {
        "length": size,
        "n_words": n,
        "avg_word_length": share(F.aggregate(words, F.lit(0), lambda acc, w: acc + F.length(w)), n),
        "n_digits": count_of(text, DIGIT).cast("double"),
        "n_uppercase": upper.cast("double"),
        "n_periods": count_of(text, ".").cast("double"),
        "n_special_chars": F.regexp_count(text, F.lit(f"[^{ALNUM}{SPACE}]")).cast("double"),
        "n_sentences": F.regexp_count(text, F.lit("[.!?]+")).cast("double"),
        "is_numeric_token": _flag(text.rlike(f"^[{DIGIT}]+$")),
        "is_mixed_alphanum": _flag(text.rlike(f"[{DIGIT}]") & text.rlike(f"[{LETTER}]")),
        "capital_ratio": share(upper, upper + lower),
        "keyword_score_title": share(title, n),
        "char_entropy": char_entropy(text),
        "distinct_ratio": share(F.size(F.array_distinct(F.split(text, ""))), size),
        "vowel_ratio": share(vowels, size),
        "cv_balance": share(letters - 2 * vowels, size),
        "max_digit_run": longest(text, r"\p{Nd}+").cast("double"),
        "uniq_bigram_ratio": F.coalesce(share(F.size(F.array_distinct(bigrams)), size - 1), F.lit(0.0)),
        "cap_run_norm": share(longest(text, f"[{CAPITALS}]+"), size),
        "percentile_token_length": F.lit(0.0),
        "token_distance_to_next": F.lit(0.0),
        "token_distance_to_prev": F.lit(0.0),
    }
