import duckdb
import pytest

LONG = "lorem ipsum dolor sit amet " * 8000
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew a strange potion " * 6


def rows():
    """Nulls, empty and very long texts, ties, repeated rows, and shared passages."""
    return [
        (1, None, "en", "a"),
        (2, "", None, "a"),
        (3, " \t\n\x0b ", "en", None),
        (4, LONG, "en", "b"),
        (5, "Hello there,  world\nsecond line here now", "en", "b"),
        (6, "Hello there, world\nsecond  line here now", "en", "b"),
        (7, "Hello there, world\nsecond line here now ", "en", "c"),
        (7, "Hello there, world\nsecond line here now ", "en", "c"),
        (None, "a row without an id\n12 34", None, "c"),
        (8, "x1 " + PASSAGE + "tail of the eighth", "en", "c"),
        (9, "another head " + PASSAGE + "tail of the ninth", "en", "d"),
        (10, "der die das und ein über große Straße\n" + "aaaa" * 150, "de", "d"),
        (11, "le la les été où çà être\nle la les été où çà être là", "fr", "d"),
        (12, "le la les été où çà être", "fr", None),
        (-3, "12 34 56 !!", "en", "e"),
        (13, "mail me a.b@c.example.org or 10.0.0.255, +1 (269) 555-3296 4111111111111111 ok", "en", "e"),
    ]


SCHEMA = "doc_id bigint, text string, lang string, source string"
CLASHING = "_id int, _text string, _n int, _line int, _source string, _token int, _row string, _key int, _bucket int, _fp int, n int, kept int, copies int, removed int, spans int"


@pytest.fixture(scope="module")
def edge_docs(spark):
    """The edge rows with further columns whose names the operators might use themselves."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows(), SCHEMA)
    for column in CLASHING.split(", "):
        name, kind = column.split(" ")
        docs = docs.withColumn(name, F.lit(9).cast(kind))
    return docs.withColumn("n_chars", F.lit(1).cast("bigint"))


@pytest.fixture(scope="module")
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="module")
def given_docs(sf_dir):
    """(doc_id, text, lang, source) of the given documents."""
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()
