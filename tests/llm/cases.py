"""Rows that every operator has to get through."""

SCHEMA = "doc_id long, text string, source string, label string, n long, id long, size long, `odd.name` string"

#: Nulls in every column, empty and blank texts, repeated rows, ties, characters of one to four bytes, a very long text.
ODD = [
    (1, "one two three four five six seven", "a", "x", 1, 1, 1, "y"),
    (2, None, "a", None, None, None, None, None),
    (3, "", None, None, None, None, None, None),
    (4, " \t\n\x0b\x0c\r ", "b", None, None, None, None, None),
    (5, "one two three four five six seven", "a", "x", 1, 1, 1, "y"),
    (5, "one two three four five six seven", "a", "x", 1, 1, 1, "y"),
    (6, "word", None, None, 3, 3, 3, "z"),
    (7, "ein schöner Tag — naïve 😀 𝔘𝔫𝔦 　 ﬁń", "c", None, None, None, None, None),
    (None, "no id at all", "c", None, None, None, None, None),
    (8, "a\u0000b   c", "c", None, None, None, None, None),
    (9, "lorem ipsum dolor " * 20_000, "c", None, None, None, None, None),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(spark, rows):
    return spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string")
