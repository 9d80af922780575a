"""Small documents with the cases every operator has to bear."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int, alphabet: str = "abcdefgh") -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(alphabet) for _ in range(draw.randint(2, 6))) for _ in range(words))


def edited(text: str, seed: int, share: float) -> str:
    draw = random.Random(seed)
    return " ".join("zz%d" % draw.randint(0, 9) if draw.random() < share else w for w in text.split(" "))


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and white texts, repeated rows, ties, one long text."""
    return [
        (1, None, "en", "src1", None), (2, "", "en", "src1", 0), (3, " \t\n\x0b ", None, None, 5),
        (4, "one", "de", "src2", 3), (4, "one", "de", "src2", 3), (5, "one", "de", "src3", 3),
        (None, "a null id of its own with some words", "en", "src0", 1), (None, None, None, None, None),
        (6, "Ünïcödé 😀 text\nwith two lines", "fr", "odd", 9), (7, "1234 5678", "en", "src1", 9),
        (8, prose(1, 20_000), "en", "src0", 1), (9, "x" * 50_000, "en", "src0", 1),
    ]


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
