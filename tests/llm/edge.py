"""Small tables with every awkward row: nulls, empties, long texts, ties, repeats, clashing extra columns."""

from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet " * 8000
CLASHES = ("_rid", "sha", "_sha256", "n", "keep", "key", "node", "component", "_gone", "h", "kept", "lang_pred", "held_out", "size", "_range", "classes", "rare", "_id", "vec", "first")


def documents(spark):
    body = "the quick brown fox jumps over the lazy dog while seven wizards quickly vex the jolly dwarf and then run back home again"
    rows = [
        (1, body, "en"), (2, body.replace(" ", "\t \n"), "en"), (3, body + " now", None), (5, None, "en"), (6, "", "de"), (7, " \t\n ", "de"), (8, "two words", "de"), (9, "Two  words", "de"),
        (10, LONG, "la"), (11, LONG + "end", "la"), (12, "x" * 30_000, None), (13, body, "en"), (13, body, "en"), (None, body, "en"), (None, "only here", None), (14, "1234 5678 !?", "en"), (15, "der schnelle braune fuchs springt über den faulen hund und läuft dann wieder nach hause zurück", "de"),
    ]
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df


def plain(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
