"""Small tables with the odd cases every operator must take."""

ODD_TEXTS = [None, "", " \n\t ", "one", "one two", "one two", "word " * 9, "long " * 30000, "The the THE the the the the the", "a|b #c $d %e &f <g> *h", "é ü ß 中 文 🙂", "line one here\nline one here\n\nother line", "tail\n"]


def odd_documents(spark, extra=()):
    """Nulls in any column, repeated rows, and columns whose names clash with common inner ones."""
    rows = [(i, t, [None, "en"][i % 2], ["s1", None, "s0"][i % 3], None, i, i) for i, t in enumerate([*ODD_TEXTS, *extra])]
    rows += [(3, "one", "en", "s1", 3, 3, 3), (3, "one", "en", "s1", 3, 3, 3), (None, "no id at all", "en", "s0", 1, 1, 1), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, bin long")


def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
