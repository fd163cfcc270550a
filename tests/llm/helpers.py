"""Small fixtures that every text operator must survive."""

NASTY = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "Hello  world\n\n x "), (6, "  lead and trail  "), (7, "naïve Ünïcode ñ 中文字 😀 é"),
    (8, "tab\tsep\x0bvt\x1cfs nbsp　wide"), (9, "it's we'll I'd they've 12345 67 !!! ... a.b,c"), (10, "x" * 5000), (11, "ab" * 3000),
    (12, "word " * 4000), (13, "word " * 4000), (14, "Hello  world\n\n x "), (15, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa bbbb " * 50), (None, "no id here"), (16, "\n\n\n"), (17, "a\nb\na\nb\n c"),
]


def docs(spark, rows=NASTY, extra=True):
    """documents with columns whose names clash with what operators use inside."""
    full = [(i, t, "en", "s", len(t or ""), 1, 2, 3) for i, t in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    if not extra:
        return spark.createDataFrame([r[:5] for r in full], names)
    return spark.createDataFrame(full, names + ", gram int, key int, label int")
