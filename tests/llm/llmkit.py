"""Small tables for the tests."""

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, extra=()):
    """Rows of documents with ids 0, 1, ...; (id, text) pairs give their own. Clashing names come along."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    rows = [(i, t, "en", "s", None if t is None else len(t), 1, "x") for i, t in rows]
    return spark.createDataFrame(rows, DOC + ", node int, label string").withColumnRenamed("label", "token")
