import pytest

LONG = " ".join(f"word{k % 977} and{k % 13}" for k in range(40_000))
#: Columns that operators use inside; extra ones of these names must not matter.
CLASHES = "key node component component_id kept words topic probability score votes digest shingles sha first mark row n_tokens start".split()


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in each column, empty, blank, letterless and very long texts, ties, repeated rows, clashing columns."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf of the north " * 4
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, " \n\t ", "de", "b", 4),
        (None, base + " with a tail", "en", "b", 5),
        (None, None, None, None, None),
        (6, "12345 !!! ###", "xx", "b", 6),
        (7, LONG, "en", "c", 7),
        (8, LONG + " end", "en", "c", 7),
        (9, "one two", "en", None, 2),
        (10, "ONE two", None, "c", 2),
        (11, "\u0000 😀 ünï cödé   x".encode("utf-16", "surrogatepass").decode("utf-16"), "de", "c", 9),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(rows, schema)
    for name in CLASHES:
        from pyspark.sql import functions as F

        frame = frame.withColumn(name, F.lit("clash"))
    return frame.repartition(3)


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()
