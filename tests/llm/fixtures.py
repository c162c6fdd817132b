"""Small tables with the cases every training-data operator defines."""

import random

from pyspark.sql import functions as F

CLASH = ["id", "text_key", "bits", "part", "size", "key", "length", "rank", "shard", "group", "root", "hash", "n", "label", "score"]


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def messy_rows(seed=3, n=60):
    """(doc_id, text, lang, source): nulls, empty and blank texts, a long text, copies, repeated rows."""
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randint(1, 90)), "en", f"s{i % 4}") for i in range(n)]
    rows[3] = (3, None, "en", "s0")
    rows[4] = (4, "", None, None)
    rows[5] = (5, " \n\t ", "en", "s1")
    rows[6] = (6, words(rng, 9000), "en", "s2")
    rows[7] = (7, rows[8][1], "en", "s3")
    rows[9] = (9, "one", "en", None)
    rows[10] = (10, "Ärger über den Süßstoff, größer – 'quoted' 3.14!", "de", "é")
    rows += [rows[20], rows[20], (None, rows[21][1], "en", "s1"), (None, "nobody's own text " + words(rng, 30), "en", "s1"), (None, None, None, None)]
    rows += [(22, words(rng, 40), "en", "s2")]  # an id again with another text
    rows += [(900 + i, rows[30][1], "en", "s0") for i in range(40)]  # a group of copies
    return rows


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    if clash:
        for c in CLASH:
            df = df.withColumn(c, F.lit("x"))
        df = df.withColumn("a.b", F.lit(1))
    return df.repartition(5)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
