"""Small awkward tables for the operators."""

from __future__ import annotations

import random

#: null and empty texts, blanks only, repeated rows, a null id, ties, one very long text
AWKWARD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "one", "en", "b"), (4, "one", "en", "b"),
    (None, "no id here but some words to read", "en", "c"), (5, "One  two\nthree\x0bfour\x0c\r", "fr", None),
    (6, "é Ü ß — 漢字 <|endoftext|> 's don't   x", "de", "c"), (7, "one", "es", "é"),
    (8, "\n".join(f"word{k} and word{k % 7} again, MIT License" for k in range(4000)), "en", "a"),
]


def documents(spark, rows, extra: bool = True):
    """Rows as a documents table, with columns whose names clash with the operators' own."""
    data = [(i, t, lang, s, len(t or ""), -1, "mine") for i, t, lang, s in rows]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, size int, labels string")
    for name in ("score", "predicted", "n_lines", "n_words", "target", "key", "sig", "row", "pos", "rank", "block", "statistics"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rng.randint(0, 30)) for _ in range(n))
