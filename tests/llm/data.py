"""Small awkward tables for all operators."""

from pyspark.sql import functions as F

LONG = "the word and of " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here now", "en", "a"),
    (2, "the quick  brown fox\tjumps over the lazy dog and runs far away from here now", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \n\t ", "en", "a"),
    (6, LONG, "en", "a"),
    (7, "the quick brown fox jumps over the lazy dog and runs far away from here now", "en", "a"),
    (7, "the quick brown fox jumps over the lazy dog and runs far away from here now", "en", "a"),
    (8, "Ünïcode <|endoftext|> ÄÖÜ ß 漢字 🙂 it's\nline\n\nline", "de", "b"),
    (None, "no id here at all", "en", None),
    (9, "same\nsame\nsame", "en", "c"),
    (10, "one", "en", "c"),
    (10, "two words", "en", "c"),
]


def awkward(spark, clash: bool = True):
    """Null ids, texts and sources, empty and very long texts, repeated rows and ids, and columns whose names operators
    use inside."""
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], SCHEMA)
    if clash:
        df = df.withColumns({c: F.lit("x") for c in ("id", "h", "n", "t", "run", "keys", "_t", "_bad", "page", "salt", "key", "part", "score", "held_out")})
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(i, 1, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int")
