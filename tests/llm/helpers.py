"""Tables of odd rows that every operator must take."""

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, word string, label int, row long"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))


def odd_documents(spark, texts=()):
    """Nulls, empty and long texts, repeated rows and ids, blank lines, odd characters, clashing columns."""
    rows = [
        (1, "The one and only text, once more.\nA second line here.", "en"),
        (1, "The one and only text, once more.\nA second line here.", "en"),
        (1, "Another text with the id of the first.", None),
        (2, None, "en"),
        (3, "", None),
        (4, " \t\n\x0b\n", "en"),
        (None, "No id at all, but words there are.", "en"),
        (None, None, None),
        (5, LONG, "en"),
        (6, "\u00e9\U0001f600 \x1c\x85\u00a0 \u0130 a\x00b", "fr"),
    ] + [(100 + i, t, "en") for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, l, None, None if t is None else len(t), 1, "k", "w", 0, 2) for i, t, l in rows], DOC)


def no_documents(spark):
    return spark.createDataFrame([], DOC)
