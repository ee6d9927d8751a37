"""Line dedup: lines found in many documents are dropped from all of them.

Lines are exploded as hashes of their normalised keys, documents per hash are
counted with a partial count before the shuffle, hashes at or over the threshold
are joined back to the lines, and each text is put together again by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adega.llm.common import BLANKS, ascii_lower, free_name, hash128

#: a frequent key's lines are dealt to this many reducers
SALTS = 32


def drop_frequent_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``text`` rewritten, plus ``n_lines`` (before) and ``n_dropped``.

    A text is split at ``\\n`` (null and empty: one empty line).  A line's key is
    the line without blanks at its ends, A-Z in lower case; keys of at least
    ``min_chars`` code points found in at least ``min_docs`` documents lose all
    their lines.  The other lines stay as they are, joined by ``\\n``.

    Each row counts as a document of its own, repeated rows and repeated ids too.
    A null text comes back as the empty string.  Other columns pass through; if
    ``docs`` already has a column ``n_lines`` or ``n_dropped`` the new one gets a
    trailing underscore.  An empty table gives an empty table.

    What is dropped depends on the text alone, so rows are rejoined by a 128-bit
    hash of the text; a text that repeats is exploded once for the join."""
    names = {n: free_name(docs, n) for n in ("n_lines", "n_dropped")}
    h1, h2, lines, drop = (free_name(docs, n) for n in ("text_h1", "text_h2", "lines", "drop"))

    body = F.coalesce(F.col(text), F.lit(""))
    keyed = F.transform(
        F.split(body, "\n"),
        lambda line: _key_hash(F.btrim(ascii_lower(line), F.lit(BLANKS)), min_chars))
    # (h1, h2) of the text, and its lines' keys with positions; a key counts once a document
    hashed = docs.select(*hash128(body, "t1", "t2"), keyed.alias("ks"))
    frequent = (
        hashed.select(F.explode(F.array_distinct("ks")).alias("k")).where("k is not null")
        .groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
        .select("k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    places = hashed.dropDuplicates(["t1", "t2"])  # copies of a text are looked up once
    hits = (
        places.select("t1", "t2", F.posexplode("ks").alias("pos", "k")).where("k is not null")
        .withColumn("salt", F.pmod(F.xxhash64("t1", "pos"), F.lit(SALTS)).cast("int"))
        .join(frequent, ["k", "salt"])
        .groupBy("t1", "t2").agg(F.collect_list("pos").alias("drop"))
        .select(F.col("t1").alias(h1), F.col("t2").alias(h2), F.col("drop").alias(drop)))

    split = docs.select(*[c for c in docs.columns if c != text], F.split(body, "\n").alias(lines), *hash128(body, h1, h2))
    joined = split.join(hits, [h1, h2], "left")
    none = F.array().cast("array<int>")
    n = F.size(lines)
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce(F.col(drop), none)),
        lambda i: F.element_at(F.col(lines), i + 1))
    whole = F.when(F.col(drop).isNull(), F.array_join(F.col(lines), "\n")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[whole.alias(c) if c == text else F.col(c) for c in docs.columns],
        n.cast("long").alias(names["n_lines"]),
        F.size(F.coalesce(F.col(drop), none)).cast("long").alias(names["n_dropped"]))


def _key_hash(key, min_chars: int):
    """128-bit hash of a line's key, null for keys under ``min_chars``."""
    return F.when(F.char_length(key) >= min_chars, F.struct(
        F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7_046_029), key).alias("b")))
