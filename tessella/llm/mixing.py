"""Mixing to target weights: iterative proportional fitting and calibrated sampling, in SQL functions only.

Documents fall into cells of source, language and topic. Raking scales the token shares of the cells to
the target share of each source, language and topic in turn, SWEEPS times over, and again until all
marginals are within TOLERANCE of their targets or come no closer to them. A cell's documents are
then sampled with one probability, its raked share over its natural share times a common factor; where
that passes 1 the cell is taken whole, and the factor is raised so that the expected tokens are the
wanted ones. The draw of a document is a hash of its id, so it is the same at any time and place.

Only the table of cells is iterated on. It has a row for each combination, not for each document; while
it has at most CELLS rows one task holds it and the sweeps need no shuffle, and its probabilities are
broadcast; beyond that sums are aggregated and joined back, a step at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .quality_rules import word_list
from .shared import discard, join_hot, materialize, workdir

DIMENSIONS = ("source", "lang", "topic")
#: Without a target of its own, a value's share is proportional to its natural share to this power: below 1 favours the rare.
POWERS = {"source": 0.5, "lang": 0.5, "topic": 0.8}
SWEEPS, CELLS, NONE = 12, 100_000, "(none)"
#: How far a marginal may be from its target, and times that SWEEPS sweeps are made at most.
TOLERANCE, TURNS = 1e-7, 50
Targets = dict[str, dict[str, float]]


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def topic_of(text: Column) -> Column:
    """The class of content of a whole text; the tables have no topics of their own.

    markup: a twentieth of the characters or more are of ``#*$%&|<>``; data: a tenth or more are digits;
    list: a line for each eight words or fewer; brief: fewer than 100 words; else prose.
    """
    size, n = F.length(text), F.size(word_list(text))
    lines = size - _without(text, "\n") + 1
    return (
        F.when(20 * (size - _without(text, "#*$%&|<>")) >= F.greatest(size, F.lit(1)), "markup")
        .when(10 * (size - _without(text, "0123456789")) >= F.greatest(size, F.lit(1)), "data")
        .when(8 * lines >= n, "list")
        .when(n < 100, "brief")
        .otherwise("prose")
    )


def features(docs: DataFrame) -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [
        F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"),
        topic_of(text).alias("topic"),
        F.size(word_list(text)).cast("long").alias("n_tokens"),
    ]


def draw(seed: int) -> Column:
    """A number in [0, 1) from doc_id; documents without an id share one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _named(d: str, targets: Targets) -> tuple[Column, float]:
    """The target that a value of dimension d is given (null: none), and the share left for values without one."""
    given = targets.get(d, {})
    column = F.lit(None).cast("double")
    if given:
        column = F.create_map(*[F.lit(x) for k, v in given.items() for x in (k, float(v))])[F.col(d)]
    return column, max(0.0, 1.0 - sum(given.values()))


def check_targets(targets: Targets) -> None:
    for d, given in targets.items():
        if d not in DIMENSIONS or any(not 0 <= x <= 1 for x in given.values()) or sum(given.values()) > 1 + 1e-9:
            raise ValueError(f"targets of {d}: shares of {', '.join(DIMENSIONS)} between 0 and 1 that add up to 1 at most")


def with_targets(cells: DataFrame, powers: dict | None = None, targets: Targets | None = None) -> DataFrame:
    """(source, lang, topic, tokens, share, t_..., w): natural shares, target shares, and weights to begin with."""
    powers, targets = powers or POWERS, targets or {}
    whole = W.Window.partitionBy()
    total = F.sum("tokens").over(whole)
    rows = cells.withColumn("share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), total), F.lit(0.0)))
    for d in DIMENSIONS:
        own = F.sum("share").over(W.Window.partitionBy(d))
        rows = rows.withColumn(f"n_{d}", own).withColumn(f"cells_{d}", F.count("*").over(W.Window.partitionBy(d)))
        power, n = F.pow(f"n_{d}", F.lit(powers[d])), F.col(f"cells_{d}")
        given, left = _named(d, targets)
        if d in targets:
            rest = F.sum(F.when(given.isNull() & (F.col(f"n_{d}") > 0), power / n)).over(whole)
            rows = rows.withColumn(f"p_{d}", F.coalesce(given, F.try_divide(F.lit(left) * power, rest), F.lit(0.0)))
        else:
            rows = rows.withColumn(f"p_{d}", power)
        # each cell holds its part of the value's weight, so that the whole table sums to the norm
        norm = F.sum(F.when(F.col(f"n_{d}") > 0, F.col(f"p_{d}") / n).otherwise(0.0)).over(whole)
        rows = rows.withColumn(f"t_{d}", F.when(F.col(f"n_{d}") > 0, F.coalesce(F.try_divide(F.col(f"p_{d}"), norm), F.lit(0.0))).otherwise(0.0))
    return rows.select(*DIMENSIONS, "tokens", "share", *[f"t_{d}" for d in DIMENSIONS], F.col("share").alias("w"))


def raked(rows: DataFrame) -> DataFrame:
    """SWEEPS sweeps over all dimensions."""
    for _ in range(SWEEPS):
        for d in DIMENSIONS:
            sums = F.sum("w").over(W.Window.partitionBy(d))
            rows = rows.withColumn("w", F.coalesce(F.try_divide(F.col("w") * F.col(f"t_{d}"), sums), F.lit(0.0)))
    return rows


def marginal_error(rows: DataFrame) -> float:
    """The largest difference of a value's share from its target."""
    worst = 0.0
    for d in DIMENSIONS:
        sums = rows.groupBy(d).agg(F.abs(F.sum("w") - F.max(f"t_{d}")).alias("x"))
        worst = max(worst, _value(sums, F.max("x")))
    return worst


def converged(rows: DataFrame, sweeps, folder: str) -> DataFrame:
    """rows after sweeps(rows, turn) until the marginals are met, or, where no weights meet them all, come no closer."""
    before = float("inf")
    for turn in range(TURNS):
        rows = materialize(sweeps(rows, turn), f"{folder}/raked-{turn}")
        error = marginal_error(rows)
        if error <= TOLERANCE or error > 0.99 * before:
            break
        before = error
    return rows


def probabilities(cells: DataFrame, keep_share: float, folder: str, powers: dict | None = None, targets: Targets | None = None) -> DataFrame:
    """(source, lang, topic, raked_share, probability) of cells(source, lang, topic, tokens)."""
    rows = converged(with_targets(cells, powers, targets), lambda x, turn: raked(x.coalesce(1)), folder)
    rows = rows.coalesce(1).withColumn("ratio", F.try_divide("w", "share"))
    # cells whose ratio is largest are capped first; the factor for k capped cells meets the wanted share
    order = W.Window.partitionBy().orderBy(F.desc("ratio"), *DIMENSIONS)
    before = order.rowsBetween(W.Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.Window.unboundedFollowing)
    capped = F.coalesce(F.sum("share").over(before), F.lit(0.0))
    factor = F.try_divide(F.lit(float(keep_share)) - capped, F.sum("w").over(after))
    rows = rows.withColumn("factor", factor).withColumn("fits", F.col("factor") * F.col("ratio") <= 1)
    chosen = F.first(F.when(F.col("fits"), F.col("factor")), ignorenulls=True).over(
        order.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    )
    probability = F.least(F.lit(1.0), F.coalesce(chosen * F.col("ratio"), F.when(F.col("ratio") > 0, 1.0), F.lit(0.0)))
    return rows.select(*DIMENSIONS, F.col("w").alias("raked_share"), probability.alias("probability"))


def _cell_hash() -> Column:
    return F.concat_ws("/", *DIMENSIONS)


def _value(rows: DataFrame, total: Column) -> float:
    return float(rows.agg(total).first()[0] or 0.0)


def many_probabilities(cells: DataFrame, keep_share: float, folder: str, powers: dict | None = None, targets: Targets | None = None) -> DataFrame:
    """``probabilities`` for cells too many for one task, however unevenly their values are spread.

    Sums by value are partial aggregates joined back, each step is written to ``folder``, and the common
    factor is found by raising it until no further cell reaches 1.
    """
    powers, targets = powers or POWERS, targets or {}
    total = _value(cells, F.sum("tokens"))
    rows = cells.withColumn("share", F.col("tokens") / F.lit(total) if total else F.lit(0.0))
    for d in DIMENSIONS:
        given, left = _named(d, targets)
        sums = rows.groupBy(d).agg(F.pow(F.sum("share"), F.lit(powers[d])).alias("p")).filter("p > 0").withColumn("given", given)
        sums = materialize(sums, f"{folder}/values-{d}")
        if d in targets:
            rest = _value(sums.filter("given is null"), F.sum("p"))
            sums = sums.withColumn("p", F.coalesce("given", F.col("p") * F.lit(left / rest if rest else 0.0)))
        norm = _value(sums, F.sum("p"))
        sums = materialize(sums.select(d, (F.col("p") / F.lit(norm) if norm else F.lit(0.0)).alias(f"t_{d}")), f"{folder}/targets-{d}")
        rows = join_hot(materialize(rows, f"{folder}/rows-{d}"), sums, d, _cell_hash(), f"{folder}/hot-{d}", "left").fillna(0.0, [f"t_{d}"])
    rows = materialize(rows.withColumn("w", F.col("share")), f"{folder}/rake-start")

    def sweeps(rows: DataFrame, turn: int) -> DataFrame:
        for k in range(SWEEPS):
            for d in DIMENSIONS:
                sums = rows.groupBy(d).agg(F.sum("w").alias("n"))
                scaled = F.coalesce(F.try_divide(F.col("w") * F.col(f"t_{d}"), F.col("n")), F.lit(0.0))
                joined = join_hot(rows, sums, d, _cell_hash(), f"{folder}/hot-{turn}-{k}-{d}")
                rows = materialize(joined.withColumn("w", scaled).drop("n"), f"{folder}/rake-{turn}-{k}-{d}")
        return rows

    rows = converged(rows, sweeps, folder)
    rows = rows.withColumn("ratio", F.try_divide("w", "share"))
    factor, capped = 0.0, -1.0
    while True:
        full = F.coalesce(F.lit(factor) * F.col("ratio") > 1, F.lit(False))
        sums = rows.agg(F.sum(F.when(full, F.col("share"))).alias("s"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if (sums.s or 0.0) == capped or not sums.w:
            break
        capped = sums.s or 0.0
        factor = max(factor, (keep_share - capped) / sums.w)
    probability = F.coalesce(F.least(F.lit(1.0), F.lit(factor) * F.col("ratio")), F.lit(0.0))
    return rows.select(*DIMENSIONS, F.col("w").alias("raked_share"), probability.alias("probability"))


def fitted(slim: DataFrame, keep_share: float, folder: str, powers: dict | None, targets: Targets | None) -> tuple[DataFrame, bool]:
    """Probabilities by cell of slim(source, lang, topic, n_tokens), and whether they are few enough for broadcast."""
    check_targets(targets or {})
    cells = materialize(slim.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), f"{folder}/cells")
    few = cells.count() <= CELLS
    found = (probabilities if few else many_probabilities)(cells.coalesce(1) if few else cells, keep_share, f"{folder}/fit", powers, targets)
    found = materialize(found, f"{folder}/probabilities")
    discard(slim.sparkSession, f"{folder}/cells", f"{folder}/fit")
    return found, few


def _with_probability(rows: DataFrame, found: tuple[DataFrame, bool]) -> DataFrame:
    table, few = found
    return rows.join(F.broadcast(table) if few else table, list(DIMENSIONS))


def mix(docs: DataFrame, keep_share: float = 0.5, seed: int = 7, powers: dict | None = None, targets: Targets | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, sampled) of every row of docs(doc_id, text, lang, source, ...).

    ``targets`` gives shares by dimension and value, as ``{"lang": {"en": 0.6, "de": 0.1}}``; the values without one
    share the rest by natural share to the dimension's power, and values that don't occur leave theirs to the others.

    Tokens are words, of whole texts however long. A null source or lang is the value ``(none)``. Documents
    without words weigh nothing: they go with their cell, and a cell of such documents alone has probability 0.
    Rows that repeat a doc_id, and all without one, are drawn together; of cells of equal ratios the first by
    name is taken whole first. Other columns are not read. An empty table gives no rows.
    """
    folder = workdir(docs.sparkSession, "mix")
    slim = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *features(docs)), f"{folder}/features")
    joined = _with_probability(slim, fitted(slim, keep_share, folder, powers, targets))
    return joined.select(
        "doc_id", *DIMENSIONS, "n_tokens", F.round("probability", 6).alias("probability"),
        (draw(seed) < F.col("probability")).alias("sampled"),
    )


def sample_documents(docs: DataFrame, keep_share: float = 0.5, seed: int = 7, powers: dict | None = None, targets: Targets | None = None) -> DataFrame:
    """The sampled rows of docs with all their columns; texts are read twice and shuffled only beyond CELLS cells."""
    folder = workdir(docs.sparkSession, "mix")
    slim = materialize(docs.select(*features(docs)), f"{folder}/features")
    found = fitted(slim, keep_share, folder, powers, targets)
    discard(docs.sparkSession, f"{folder}/features")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id"), *features(docs))
    return _with_probability(rows, found).filter(draw(seed) < F.col("probability")).select("row.*")


def oracle(keep_share: float = 0.5, seed: int = 7) -> str:
    """DuckDB SQL for ``mix`` over the table documents."""
    spaces = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    steps, last = [], "c0"
    for k in range(SWEEPS):
        for d in DIMENSIONS:
            name = f"s{k}_{d}"
            steps.append(
                f"{name} AS (SELECT * REPLACE (coalesce(w * t_{d} / nullif(sum(w) OVER (PARTITION BY {d}), 0), 0.0) AS w) FROM {last})"
            )
            last = name
    targets = ", ".join(
        f"coalesce(power(n_{d}, {POWERS[d]}) / nullif((SELECT sum(power(n, {POWERS[d]})) FROM (SELECT sum(share) AS n FROM shares GROUP BY {d}) WHERE n > 0), 0), 0.0) AS t_{d}"
        for d in DIMENSIONS
    )
    sums = ", ".join(f"sum(share) OVER (PARTITION BY {d}) AS n_{d}" for d in DIMENSIONS)
    symbols = "regexp_replace(t, '[#*$%&|<>]', '', 'g')"
    return f"""
WITH base AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS t FROM documents),
counted AS (SELECT *, CAST(len(list_filter(string_split(translate(t, {spaces}, '     '), ' '), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM base),
f AS (SELECT doc_id, source, lang, n_tokens,
  CASE WHEN 20 * (length(t) - length({symbols})) >= greatest(length(t), 1) THEN 'markup'
    WHEN 10 * (length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) >= greatest(length(t), 1) THEN 'data'
    WHEN 8 * (length(t) - length(replace(t, chr(10), '')) + 1) >= n_tokens THEN 'list'
    WHEN n_tokens < 100 THEN 'brief' ELSE 'prose' END AS topic FROM counted),
cells AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM f GROUP BY ALL),
shares AS (SELECT *, coalesce(CAST(tokens AS DOUBLE) / nullif(sum(tokens) OVER (), 0), 0.0) AS share FROM cells),
sums AS (SELECT *, {sums} FROM shares),
c0 AS (SELECT source, lang, topic, share, share AS w, {targets} FROM sums),
{", ".join(steps)},
r AS (SELECT *, w / nullif(share, 0) AS ratio FROM {last}),
x AS (SELECT *, ({float(keep_share)} - coalesce(sum(share) OVER (ORDER BY ratio DESC NULLS LAST, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / nullif(sum(w) OVER (ORDER BY ratio DESC NULLS LAST, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS factor FROM r),
lam AS (SELECT arg_max(factor, ratio) AS factor FROM x WHERE factor * ratio <= 1),
p AS (SELECT source, lang, topic, least(1.0, coalesce((SELECT factor FROM lam) * ratio, CASE WHEN ratio > 0 THEN 1.0 END, 0.0)) AS probability FROM x)
SELECT f.doc_id, f.source, f.lang, f.topic, f.n_tokens, round(p.probability, 6) AS probability,
  CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(f.doc_id AS VARCHAR), '')), 1, 8)) AS UBIGINT) / 4294967296.0 < p.probability AS sampled
FROM f JOIN p ON f.source = p.source AND f.lang = p.lang AND f.topic = p.topic
"""
