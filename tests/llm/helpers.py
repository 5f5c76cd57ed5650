"""Small tables for the operators, with columns whose names clash with internal ones."""

from __future__ import annotations

CLASHING = ("place", "key", "fp", "n", "block", "id", "grp", "start", "score", "words", "bad_id", "gone_id", "text_place")


def documents(spark, rows, lang=False):
    """(doc_id, text[, lang]) and clashing columns from (doc_id, text[, lang]) tuples."""
    names = "doc_id long, text string" + (", lang string" if lang else "")
    df = spark.createDataFrame(rows, names) if rows else spark.createDataFrame([], names)
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING))


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))
