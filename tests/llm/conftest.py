import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use inside, as further columns of the input
CLASH = ["k", "t", "h", "id", "key", "fp", "rep", "size", "draws", "block", "rank", "kind", "w", "list",
         "words", "chars", "lang_key", "leaked_id_", "kept_id_", "component", "node", "host", "n", "logs"]


def frame(spark, rows, clash=True):
    """documents with edge rows and, if asked, clashing further columns."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, DOC)
    for c in CLASH if clash else []:
        df = df.withColumn(c, F.lit("clash"))
    return df


PROSE = ("the of and to in a is that for it with as from this by they have not are but had his were all one "
         "their there been many some would time about could people than first water long little very after "
         "words just where most know get through back much before line right too means old any same tell boy")


def prose(n, seed=0):
    import random
    r = random.Random(seed)
    return " ".join(r.choice(PROSE.split()) + r.choice(["", "", "ing", "er", "ly"]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    long = prose(30_000, 5)
    return [
        (1, None, "en", "s1", None), (2, "", "en", "s1", 0), (3, " \t\n ", None, "s2", 3), (4, "one", "en", None, 3),
        (5, prose(120, 1), "en", "s1", 9), (6, prose(120, 1), "en", "s1", 9), (6, prose(120, 1), "en", "s1", 9),
        (7, long, "en", "s2", 9), (8, prose(200, 2) + "\nà é ñ ü 日本語 \U0001f600\x00 ", "xx", "s2", 9),
        (None, prose(80, 3), "de", "s1", 9), (9, "A" * 300_000, "fr", None, 9), (10, prose(120, 1) + " x", "en", "s3", 9),
        (-5, "### $$$ 123", None, None, None),
    ]
