"""Small tables with the cases every operator must handle."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, rank string, size string, block string, component string"


def prose(seed: int, words: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(words))


def lines(seed: int, n: int, words: int = 9) -> list[str]:
    return [prose(seed * 1000 + i, words) for i in range(n)]


def rows() -> list[tuple]:
    """(doc_id, text, lang, source): nulls in every column, empty and white
    texts, copies, near copies, a very long text, repeated rows."""
    a, b, c = lines(1, 8), lines(2, 6), lines(3, 6)
    near = "\n".join(a).split(" ")
    near[3] = "changed"
    out = [
        (1, "\n".join(a), "en", "s1"), (2, "\n".join(a), "en", "s2"), (3, " ".join(near), "en", "s1"),
        (4, "\n".join(b), "fr", "s2"), (5, "\n".join(c[:2] + b[1:] + c[2:]), "fr", None), (6, "\n".join(b).replace(" ", "  "), None, "s1"),
        (7, None, "en", "s1"), (8, "", "en", None), (9, " \n\t ", None, None), (10, "one two", "fr", "s3"), (11, "ONE two", "fr", "s3"),
        (12, "12 34 !? ###", "en", "s3"), (None, "\n".join(a), "en", "s1"), (None, None, None, None), (13, prose(9, 30000), "en", "s2"),
        (14, "\n".join(c), "en", "s1"), (14, "\n".join(c), "en", "s1"), (15, "x" * 50000, None, "s1"), (16, "\n".join(["same line here today"] * 30), "en", "s1"),
    ]
    return out


def frame(spark, data=None):
    """The rows with extra columns whose names operators use inside."""
    data = rows() if data is None else data
    return spark.createDataFrame([(d, t, g, s, None if t is None else len(t), 77, "r", "s", "b", "c") for d, t, g, s in data], SCHEMA)
