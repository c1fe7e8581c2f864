"""Small tables with every awkward case."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, schema=DOCUMENTS):
    return spark.createDataFrame(rows, schema)


def awkward(spark):
    """Nulls in every column, an empty text, blanks, a very long text, ties and repeated rows."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [
        (1, "alpha beta gamma delta", "en", "a", 4), (2, None, "en", "a", None), (3, "", "de", "b", 0), (4, " \n\t ", None, None, 4), (5, long, "en", "a", len(long)),
        (6, "alpha beta gamma delta", "en", "a", 4), (6, "alpha beta gamma delta", "en", "a", 4), (None, "alpha beta", "fr", "c", 10), (7, "Ünï cödé … 漢字 🙂", "en", None, 10),
    ]
    return documents(spark, rows)


def empty(spark):
    return documents(spark, [])


def clashing(df):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["size", "taken", "grp", "salt", "row", "component", "slot", "shard", "n_tokens", "kept", "place", "band", "word", "n_words", "path_", "id", "start", "rank", "f0", "turn", "number", "copies", "text_key", "__row", "__copy", "__words"]
    return df.withColumns({n: F.lit("x") for n in names})
