"""Small tables with the awkward rows that every operator has to take."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))


def documents(spark, extra=()):
    """Nulls in every column, empty and long texts, repeated rows, and `extra` columns with clashing names."""
    rows = [
        (1, "plain text of a few words that is here for the sake of it", "en", "a", 57),
        (1, "plain text of a few words that is here for the sake of it", "en", "a", 57),
        (2, None, "en", "a", None), (3, "", "en", "b", 0), (4, " \t\n ", None, "b", 4), (None, "text without an id", "de", None, 18),
        (None, "text without an id", "de", None, 18), (None, None, None, None, None), (5, LONG, "en", "a", len(LONG)),
        (6, "plain text of a few words that is here for the sake of it", "fr", "c", 57), (7, "Ünïcode ẞ 中文 🙂   mixed\r\nlines\x0b here", "fr", "c", 40),
        (8, "One", "en", "", 3),
    ]
    df = spark.createDataFrame(rows, DOCUMENTS)
    for name in extra:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark, schema=DOCUMENTS):
    return spark.createDataFrame([], schema)
