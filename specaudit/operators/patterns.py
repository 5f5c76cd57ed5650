"""Which texts may contain which of very many values, without comparing all texts with all values.

A value is looked up by one of its q-grams, the one that fewest texts of its group hold. Texts and values meet on that gram
alone, with ids and hashes only; the caller checks each candidate once against the text. A value is as dear as its rarest
gram is common, so a group with a third of all rows costs no more per text than a small one, and its candidates spread over
many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specaudit.session import cut

GRAM = 6  # characters; shorter values are looked up whole
PIECE = 4096  # characters of a text taken apart together


def _grams(letters: Column, size: Column) -> Column:
    """Hashes of the distinct runs of `size` letters; linear in the letters, whatever their encoding."""
    places = F.sequence(F.lit(1), F.size(letters) - size + 1)
    return F.when(F.size(letters) >= size, F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.slice(letters, i, size), size)))).otherwise(F.array().cast("array<bigint>"))


def _pieces(body: Column) -> Column:
    """A long text as overlapping pieces, so that no task takes a whole one apart; every gram is inside one of them."""
    starts = F.sequence(F.lit(0), F.floor(F.length(body) / PIECE).cast("int"))
    return F.transform(starts, lambda k: F.substring(body, k * PIECE + 1, F.lit(PIECE + GRAM - 1)))


def candidates(texts: DataFrame, values: DataFrame) -> DataFrame:
    """(group_id, text_id, value_id), each once: at least the pairs of a group where the value occurs in the text, both as given.

    `texts`: group_id, text_id, body. `values`: group_id, value_id, value. A null or empty value is no candidate, nor is a
    null text. Rows that share an id share their candidates.
    """
    size = F.least(F.length("value"), F.lit(GRAM))
    known = cut(values.where(F.length("value") > 0).select("group_id", "value_id", size.alias("q"), F.explode(_grams(F.split("value", ""), size)).alias("gram")))
    sizes = sorted(r.q for r in known.select("q").distinct().collect())  # GRAM of them at most
    if not sizes:
        return texts.join(known, "group_id").where("false").select("group_id", "text_id", "value_id")
    pieces = texts.where("body is not null").select("group_id", "text_id", F.explode(_pieces(F.col("body"))).alias("piece"))
    letters = pieces.select("group_id", "text_id", F.split("piece", "").alias("letters"))
    offered = letters.select("group_id", "text_id", F.explode(F.flatten(F.array(*(_grams(F.col("letters"), F.lit(q)) for q in sizes)))).alias("gram"))
    # Of all grams of the texts, those that occur in some value of their group.
    met = cut(offered.join(known.select("group_id", "gram").distinct(), ["group_id", "gram"], "left_semi").distinct())
    common = met.groupBy("group_id", "gram").agg(F.count("*").alias("n"))
    rarest = known.join(common, ["group_id", "gram"], "left").groupBy("group_id", "value_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    # A value with a gram that no text holds occurs nowhere.
    keyed = rarest.where("r.n > 0").select("group_id", "value_id", F.col("r.gram").alias("gram"))
    return met.join(keyed, ["group_id", "gram"]).select("group_id", "text_id", "value_id").distinct()
