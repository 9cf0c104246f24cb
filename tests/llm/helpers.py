"""Documents that every operator must survive."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Der lange Satz wiederholt sich nicht ganz. " * 4000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "src1", 63),
    (2, "The quick brown fox jumps over the lazy dog near the river bank", "en", "src0", 63),
    (3, None, "en", "src0", None), (4, "", None, None, 0), (5, " \n\t ", "de", "src2", 4), (6, "wort", "de", None, 4),
    (7, LONG, "de", "src0", len(LONG)), (8, "!!! 123 ???", None, "src3", 11), (8, "!!! 123 ???", None, "src3", 11),
    (None, "niemand kennt diese nummer", "de", "src0", 26), (9, "naïve 日本語 🎉 \u0000 end", "fr", "src1", 17),
]
LABELS = "doc_id long, quality int, toxic int"


def documents(spark, rows=None):
    """The rows with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(7) for c in ("score", "copies", "full", "label", "node", "place", "spans", "_cut", "_row", "_key", "_place", "key", "shard", "rank")})


def pairs(rows):
    return sorted((tuple(r) for r in rows), key=repr)
