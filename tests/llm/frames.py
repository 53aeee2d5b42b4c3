"""Small tables with nulls, empty and repeated rows, extra columns and clashing names."""

SCHEMA = "doc_id long, text string, source string, h string, k int"


def odd_documents(spark):
    line = "alpha beta gamma delta epsilon zeta eta theta"
    long = " ".join(f"w{k % 977}x" for k in range(30_000))
    rows = [
        (1, line + "\nother words of one document only", "s", "x", 1),
        (2, line + "\nmore words that stand here alone", None, "x", 1),
        (3, None, "s", None, None),
        (4, "", "s", "y", 2),
        (4, "", "s", "y", 2),
        (5, long, "s", "y", 2),
        (None, line, "s", "z", 3),
        (6, "  \n\n ", "s", "z", 3),
        (7, long + " end", "s", "z", 3),
        (8, "Ä é ß 日本 😀 ▁ x", "s", "z", 3),
        (-9, line + "\nother words of one document only", "s", "z", 3),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
