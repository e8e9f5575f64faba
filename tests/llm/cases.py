"""Small tables every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{k % 977} filler{k % 13}" for k in range(30_000))
BASE = " ".join(f"w{k}" for k in range(120))

#: (doc_id, text): nulls in both columns, empty and blank texts, copies, repeated rows, one id with two texts.
ROWS = [
    (1, None), (2, ""), (3, " \t\n\r"), (4, "Solo"), (5, LONG), (6, BASE), (7, BASE), (7, BASE), (7, "other text of seven"),
    (None, BASE), (None, None), (8, BASE.upper()), (9, BASE + " and more words at its end"), (10, "two words"),
    (11, "line one that is long enough\nshort\nline two that is long enough"),
    (12, "LINE one that is long enough \n\nshort"), (13, " line one that is long enough\nx"), (14, "ünïcode ÀÉ 日本語 text 🙂"),
]
SCHEMA = "doc_id long, text string"


def table(spark, rows=ROWS):
    """The rows with extra columns whose names the operators use themselves."""
    extra = {"fp": F.lit("x"), "h": F.lit(1), "block": F.lit(2), "pos": F.lit(3), "line": F.lit("l"), "spans": F.lit(4),
             "__score_old": F.lit(5), "row_id": F.lit(6), "length": F.lit(7), "y": F.lit(8), "id": F.lit(None).cast("string"),
             "k1": F.lit(9), "n": F.lit(10)}
    return spark.createDataFrame(rows, SCHEMA).withColumns(extra)


def empty(spark):
    return table(spark).where("false")
