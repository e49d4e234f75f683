"""Queries that go through files and back, and on listing cards and splits whose results SQL knows.

Each writes below the shared folder and reads what it wrote, so that readers and writers are held against the
table that went in.
"""

from __future__ import annotations

import contextlib
import uuid
from datetime import datetime

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analysis, evaluate, fast, labeling, ml
from .operators.normalize import numeric_columns
from .queries import _JUDGED, _LABELLED, LINES, _judged, _labelled, lines, query, table
from .session import shared_dir
from .sources.files import SharedFile
from .sources.paths import new_version, versions
from .sources.readers import from_token_json, read_artifact, read_csv, read_html, read_metrics, read_tokens, to_token_json
from .sources.writers import MetricLog, write_artifact, write_csv, write_distribution, write_json, write_label_ids, write_predictions, write_truth_skeleton


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {LINES} SELECT page_id AS n_words, position, text, CAST(length(text) AS DOUBLE) AS length FROM lines")
def token_json_round_trip(spark, sf_dir):
    """Lines as token records in JSON files, read back by the fixed schema; fields that nothing sets are null."""
    path = fresh(spark, "tokens")
    write_json(lines(spark, sf_dir).select("text", "position", F.length("text").cast("double").alias("length"), F.col("page_id").cast("double").alias("n_words")), path)
    rows = from_token_json(to_token_json(read_tokens(spark, path)).filter(F.col("value").contains('"tfidf_score":null')))
    return rows.select(F.col("n_words").cast("long").alias("n_words"), "position", "text", "length")


@query(f"WITH {_LABELLED} SELECT page_id, position, label FROM r WHERE label <> 'O'")
def labelled_json_scan(spark, sf_dir):
    """Of token records, of which some have a label, those that have one."""
    path = fresh(spark, "labelled")
    label = F.when(F.col("label") != "O", F.col("label")).alias("label")
    write_json(_labelled(spark, sf_dir).select("text", "position", F.col("page_id").cast("double").alias("n_words"), label), path)
    rows = read_tokens(spark, path, labelled=True)
    return rows.select(F.col("n_words").cast("long").alias("page_id"), "position", "label")


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def tolerant_json_scan(spark, sf_dir):
    """Lines of which only those of users are JSON; the others are passed over."""
    path = fresh(spark, "tolerant")
    record = F.to_json(F.struct("text", F.col("turn").alias("position"), F.col("conv_id").cast("double").alias("n_words")))
    rows = table(spark, sf_dir, "conversations")
    rows.select(F.when(F.col("role") == "user", record).otherwise(F.concat(F.lit("{no json "), F.regexp_replace("text", r"[\r\n]+", " "))).alias("value")).write.text(path)
    found = read_tokens(spark, path, tolerant=True)
    return found.select(F.col("n_words").cast("long").alias("conv_id"), F.col("position").alias("turn"), "text")


@query("SELECT conv_id, turn, role, text FROM conversations")
def csv_round_trip(spark, sf_dir):
    """Texts with quotes, commas and line feeds as CSV, read back by schema."""
    path = fresh(spark, "csv")
    write_csv(table(spark, sf_dir, "conversations"), path)
    return read_csv(spark, path, "conv_id long, turn long, role string, text string")


@query(f"WITH {LINES} SELECT text FROM lines WHERE trim(text) = text")
def truth_skeleton_file(spark, sf_dir):
    """The texts to be labelled by hand, from the file."""
    path = fresh(spark, "truth")
    write_truth_skeleton(lines(spark, sf_dir).filter(F.trim("text") == F.col("text")), path)
    return read_csv(spark, path, "text string")


@query(f"WITH {_LABELLED} SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT label FROM r)")
def label_ids_file(spark, sf_dir):
    path = f"{fresh(spark, 'ids')}.json"
    write_label_ids(labeling.label_ids(_labelled(spark, sf_dir)), path)
    return spark.createDataFrame(sorted(read_artifact(spark, path).items()), "label string, id long")


@query(f"WITH {_LABELLED} SELECT label || ': ' || count(*) AS value FROM r GROUP BY label")
def distribution_file(spark, sf_dir):
    path = fresh(spark, "distribution")
    write_distribution(analysis.label_distribution(_labelled(spark, sf_dir)), path)
    return spark.read.text(path)


@query(
    f"""WITH {_JUDGED}, x AS (SELECT CAST(doc_id AS VARCHAR) AS text, predicted_label FROM j)
SELECT 'complete' AS split, * FROM x UNION ALL SELECT CASE WHEN predicted_label = 'O' THEN 'default' ELSE 'features' END, * FROM x"""
)
def prediction_files(spark, sf_dir):
    folder = fresh(spark, "predictions")
    write_predictions(_judged(spark, sf_dir).select(F.col("doc_id").cast("string").alias("text"), "predicted_label"), folder)
    parts = [read_csv(spark, f"{folder}/{x}", "text string, predicted_label string").select(F.lit(x).alias("split"), "text", "predicted_label") for x in evaluate.SPLITS]
    return parts[0].union(parts[1]).union(parts[2])


def _page_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a page for each nation, and a file that is none."""
    folder = fresh(spark, "pages")
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():
        SharedFile(spark, f"{folder}/nation_{r.n_nationkey:02d}.html").write(f"<p>{r.n_name}\n</p>")
    SharedFile(spark, f"{folder}/note.txt").write("no page")
    return folder


_PAGE_FILES = "SELECT 'nation_' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '.html' AS filename, '<p>' || n_name || chr(10) || '</p>' AS content FROM nation"


@query(_PAGE_FILES)
def html_folder_scan(spark, sf_dir):
    return read_html(spark, _page_folder(spark, sf_dir), ordered=True)


@query(f"{_PAGE_FILES} ORDER BY filename LIMIT 5")
def html_folder_limit(spark, sf_dir):
    return read_html(spark, _page_folder(spark, sf_dir), limit=5)


@query("SELECT r_name AS newest, CAST((SELECT count(*) FROM region) AS BIGINT) AS n_versions FROM region ORDER BY r_regionkey DESC LIMIT 1")
def artifact_versions(spark, sf_dir):
    """An artifact for each region, a day apart; the last one is the current one."""
    path = f"{fresh(spark, 'artifacts')}/keys.json"
    for r in table(spark, sf_dir, "region").collect():
        write_artifact(spark, [r.r_name], new_version(spark, path, datetime(2024, 1, 1 + r.r_regionkey)))
    return spark.createDataFrame([(read_artifact(spark, path)[0], len(versions(spark, path)))], "newest string, n_versions long")


@query("SELECT r_name AS method, CASE WHEN r_regionkey = 0 THEN 500 ELSE 200 END AS status_code FROM region")
def metric_log_append(spark, sf_dir):
    """A logged call for each region, of which the first fails."""
    folder = fresh(spark, "metrics")
    log = MetricLog(spark, folder, lines=3)
    for r in table(spark, sf_dir, "region").collect():

        def call(number=r.r_regionkey):
            return 1 / number

        call.__name__ = r.r_name
        with contextlib.suppress(ZeroDivisionError):
            log.timed(call)()
    log.close()
    return read_metrics(spark, folder).select("method", "status_code")


@query("SELECT column_name AS name FROM (DESCRIBE SELECT * FROM lineitem) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') AND column_name <> 'l_linenumber'")
def numeric_column_names(spark, sf_dir):
    names = numeric_columns(table(spark, sf_dir, "lineitem"), exclude=("l_linenumber",))
    return spark.createDataFrame([(x,) for x in names], "name string")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS x0, l_discount AS x1 FROM lineitem")
def assembled_vectors(spark, sf_dir):
    """Vectors of two columns, of which one has nulls, which count as 0."""
    rows = table(spark, sf_dir, "lineitem").withColumn("a", F.when(F.col("l_returnflag") != "R", F.col("l_quantity")))
    values = vector_to_array("features")
    return ml.assemble(rows.select("l_orderkey", "l_linenumber", "a", "l_discount"), ["a", "l_discount"]).select(
        "l_orderkey", "l_linenumber", values[0].alias("x0"), values[1].alias("x1")
    )


_PATTERN_TEXTS = ("{k} €x", "{k}.500,25 € y", "{k}€", "€ {k}", "{k}.000 €uro", "a{k} LOCALI", "{k} locale", "{k},5 locali e", "{k}local", "{k} localino")


@query(
    "WITH t AS (SELECT c_custkey, unnest(["
    + ", ".join("'" + x.replace("{k}", "' || c_custkey || '") + "'" for x in _PATTERN_TEXTS)
    + r"""]) AS text FROM customer) SELECT c_custkey, text, regexp_matches(lower(text), '\b\d{1,3}(?:[.,]\d{3})*(?:[.,]\d+)?\s*€\b') AS price,
regexp_matches(lower(text), '\b\d+(?:[.,]\d+)?\s*locali?\b') AS rooms FROM t"""
)
def second_variant_patterns(spark, sf_dir):
    """What the second variant takes for prices and rooms."""
    texts = [F.concat(*[F.col("c_custkey").cast("string") if x == "k" else F.lit(x) for x in p.replace("{k}", "\0k\0").split("\0")]) for p in _PATTERN_TEXTS]
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*texts)).alias("text"))
    price, rooms = fast.block_marks(F.col("text"))
    return rows.select("c_custkey", "text", price.alias("price"), rooms.alias("rooms"))


# ---------------------------------------------------------------- listing cards

#: Items of a customer's card, as SQL and as Spark columns can build them alike.
_ITEMS = (
    ("{k} locali", "FEATURE_LOCALI"), ("{k} m²", "FEATURE_SUPERFICIE"), ("{k} BAGNI", "FEATURE_BAGNI"), ("Due bagni", "FEATURE_BAGNI"), ("Piano {s}", "FEATURE_PIANO"),
    ("con ascensore", "FEATURE_ASCENSORE"), ("Balcone {k}", "FEATURE_BALCONE"), ("Terrazzo", "FEATURE_TERRAZZO"), ("cantina", "FEATURE_CANTINA"), ("Arredato", "FEATURE_ARREDATO"),
    ("di lusso", "FEATURE_LUSSO"), ("{k} euro", "FEATURE_PREZZO"), ("01/02/2024", "FEATURE_DATA"), ("in Asta", "FEATURE_TIPOLOGIA"), ("{s}", "O"), ("{k} locali e 2 bagni", "FEATURE_LOCALI"),
)


def card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each nation with a listing card for each customer."""

    def text(pattern: str):
        first, *rest = pattern.replace("{k}", "\0k\0").replace("{s}", "\0s\0").split("\0")
        parts = [F.lit(first), *[F.col("c_custkey").cast("string") if x == "k" else F.col("c_mktsegment") if x == "s" else F.lit(x) for x in rest]]
        return F.concat(*parts)

    items = [F.concat(F.lit(f'<div class="{labeling.ITEM_CLASS}"><span> '), text(x), F.lit(" </span></div>")) for x, _ in _ITEMS]
    card = F.concat(
        F.lit(f'<div class="{labeling.CARD_CLASS}"><div class="{labeling.PRICE_CLASS}"><span>€ '), F.col("c_custkey").cast("string"),
        F.lit(f'</span><span>old</span></div><a class="{labeling.TITLE_CLASS} x">'), F.col("c_name"), F.lit("</a>"), *items, F.lit("</div>"),
    )
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", card.alias("card"))
    found = rows.groupBy(F.col("c_nationkey").cast("long").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", "card"))).alias("x"))
    return found.select("page_id", F.concat(F.lit("<html><body><span>none</span>"), F.array_join(F.col("x.card"), "<hr>"), F.lit("</body></html>")).alias("html"))


def _cards_sql() -> str:
    parts = [("'€ ' || c_custkey", labeling.PRICE_LABEL), ("c_name", labeling.TITLE_LABEL)]
    for pattern, label in _ITEMS:
        parts.append(("'" + pattern.replace("{k}", "' || c_custkey || '").replace("{s}", "' || c_mktsegment || '") + "'", label))
    rows = ", ".join(f"{{'token': {text}, 'label': '{label}'}}" for text, label in parts)
    n = len(parts)
    return f"""WITH c AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, [{rows}] AS parts FROM customer),
x AS (SELECT c_nationkey, i, unnest(parts) AS p, unnest(range({n})) AS k FROM c)
SELECT CAST(c_nationkey AS BIGINT) AS page_id, CAST(i * {n} + k AS BIGINT) AS place, p.token AS token, p.label AS label FROM x"""


@query(_cards_sql())
def card_labels_of_nations(spark, sf_dir):
    """Prices, titles and items of listing cards, labelled by the thirteen rules in order."""
    return labeling.card_labels(card_pages(spark, sf_dir))


@query(
    """WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT label, n, CASE WHEN n < 2 THEN 0 ELSE least(n - 1, greatest(1, round(0.2 * n))) END AS k FROM c)
SELECT label, 'test' AS part, CAST(k AS BIGINT) AS n FROM t UNION ALL SELECT label, 'train', CAST(n - k AS BIGINT) FROM t"""
)
def stratified_split_sizes(spark, sf_dir):
    """How many rows of each class a split gives to either side."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"))
    parts = zip(("train", "test"), ml.stratified_split(rows), strict=True)
    train, test = (x.groupBy("label").agg(F.count("*").alias("n")).select("label", F.lit(name).alias("part"), "n") for name, x in parts)
    return train.union(test)
