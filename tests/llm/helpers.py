import random

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = ["".join(random.Random(k).choices(("ka", "lo", "mi", "re", "tan", "dor", "vel", "sin"), k=3)) + str(k % 7) for k in range(400)]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) with columns that clash with names used inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for c in ("node", "band", "key", "set", "_row", "n_words", "kept", "block", "h", "shard", "ids", "start", "label", "comp", "learn"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def edge_rows():
    r = random.Random(9)
    long = prose(r, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (4, long), (5, "one"), (None, "no id at all " * 30), (None, None), (6, "é" * 5000), (7, "a b c ☃ 😀"), (8, "x" * 100_000)]
