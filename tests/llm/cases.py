"""Small tables with every awkward row, and plain helpers the brute-force versions share."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    made = ["".join(draw.choice("aeionrstlmdé") for _ in range(draw.randint(2, 8))) for _ in range(n)]
    return " ".join(w + (".\n" if i % 11 == 10 else "") for i, w in enumerate(made))


def awkward() -> list[tuple]:
    """Nulls in any column, empty and blank texts, a very long text, ties, copies, repeated rows, odd letters."""
    long = prose(1, 30_000)
    plain = prose(2, 120)
    return [
        (1, plain, "en", "a", 1), (2, plain, "en", "a", 1), (3, plain.replace("a", "A", 3), None, None, None),
        (4, None, "en", "a", 0), (5, "", "de", "b", 0), (6, " \t\n\x0b ", "de", "b", 5), (7, long, "en", "c", 2),
        (None, prose(3, 80), None, "c", 3), (None, None, None, None, None), (8, "one", "fr", "c", 3),
        (8, "one", "fr", "c", 3), (8, "two words", "fr", "c", 3), (9, " nbsp  ſtraße İ 日本語 😀", "und", "d", 9),
        (10, "a\nb\na\nb\n\n\n", "en", "d", 9), (11, "same same same same " * 40, "en", "d", 9),
        (12, prose(4, 60) + "\n" + plain, "en", "e", 1), (13, "<|endoftext|> it's it'S '' ²³ x²", "en", "e", 1),
    ]


def documents(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCS)


def odd_columns(df):
    """``df`` with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = (
        "key row_key words bucket fenced lines ends gone kept measured predicted n_words score spans size shard slot "
        "text_crc32 node component group part w0 place row s id first best digest number n row_spans row_kinds law"
    ).split()
    taken = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(f"own {c}") for c in names if c not in taken})
