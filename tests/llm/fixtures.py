"""Rows that every operator has to stand: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from pyspark.sql import types as T

PASSAGE = " ".join(f"passage{i}" for i in range(60))
EDGE = [
    (1, "Hello there, general words that are quite plain and simple.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "   \n\t ", "fr"),
    (5, "12345 67890 !!! ???", "de"),
    (6, PASSAGE, "en"),
    (7, "lead in " + PASSAGE + " and out again", "en"),
    (7, "lead in " + PASSAGE + " and out again", "en"),  # a repeated row
    (8, "word " * 20000, "en"),
    (9, "x" * 50000, "en"),
    (10, "中文 текст ελληνικά mixed ümlaut space <|endoftext|> \U0001f600 ²³½ naïve", None),
    (None, PASSAGE + " without an id", "en"),
    (12, PASSAGE, "en"),
    (13, "a", None),
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("f", "k", "score", "lang_pred", "toxicity", "licences", "digest")]])


def edge(spark):
    return spark.createDataFrame([(i, t, x, "src0", len(t or ""), *["own"] * 7) for i, t, x in EDGE], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
