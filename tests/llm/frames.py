"""Small document tables with the awkward cases every operator must take."""

LONG = "word " * 40_000 + "x" * 100_000
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog\nand runs away from here"),
    (2, "the quick brown fox jumps over the lazy dog\nand runs away from here"),
    (3, ""), (4, None), (5, LONG), (6, "<|endoftext|> Ünï\x1ccode  \n\n  日本 ͅ ẞ <|startoftext|>"),
    (6, "<|endoftext|> Ünï\x1ccode  \n\n  日本 ͅ ẞ <|startoftext|>"), (None, "no id at all"), (7, "   \n\t"), (8, "one"),
]


def documents(spark, rows=None):
    """doc_id, text and columns whose names operators use themselves."""
    rows = TEXTS if rows is None else rows
    kind = "doc_id long, text string, ids string, score string, entities string, _words int, n_words string, line_no string"
    return spark.createDataFrame([(i, t, "x", "y", "z", 1, "w", "n") for i, t in rows], kind)
