"""Small awkward tables: nulls, empty and long texts, repeats, ties, clashing extra columns."""

from tests.conftest import rows_of  # noqa: F401

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, "   \n\t ", "fr", None),
    (5, "12345 !!! 67890", "de", "b"),
    (6, "The quick brown fox jumps over the lazy dog again and again.", "en", None),
    (7, "word " * 3000, "en", "a"),
    (8, "été là où ça çà éàü ÉÀÜ", "fr", "b"),
    (9, "x", "en", "c"),
    (None, "a document without an id but with words", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a"),
]


def awkward(spark):
    """Columns of documents and some whose names the operators use themselves."""
    rows = [(*r, 0, -1, "x", 3.5) for r in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, score double")


def empty(spark):
    return awkward(spark).filter("false")


def documents(spark, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
