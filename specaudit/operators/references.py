"""`@Name` references in prompt texts, resolved against the column names of the same table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specaudit import vocab
from specaudit.functions.normalise import literal_array
from specaudit.functions.text import mark_positions
from specaudit.session import cut

_AT = r"(?U)(?<![\w@.])@(?=[A-Za-z\[])"


def _starts(text: Column) -> Column:
    """Zero-based offsets of the first character after each `@` that opens a reference."""
    return mark_positions(text, _AT)


def _guess(text: Column, start: Column) -> Column:
    """What was most likely meant when no name matches: up to six words before a stop word."""
    segment = F.regexp_extract(F.substring(text, start + 1, F.length(text)), r"^[^\n`,.;:()\[\]\"']*", 0)
    words = F.filter(F.split(segment, r"(?U)\s+"), lambda w: w != "")
    later = F.transform(F.slice(words, 2, vocab.REFERENCE_MAX_WORDS - 1), lambda w: F.array_contains(literal_array(vocab.REFERENCE_STOP_WORDS), F.lower(w)))
    stop = F.array_position(later, True)
    n = F.when(stop == 0, F.lit(vocab.REFERENCE_MAX_WORDS)).otherwise(stop).cast("int")
    return F.array_join(F.slice(words, 1, n), " ")


def find_refs(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text_id, table_id, start_at, raw, resolved_id, resolved_name) for every `@` in every text.

    `texts`: text_id, table_id, text, ids unique. `names`: table_id, column_id, name, position. The longest name that ends
    at a word boundary wins. A reference offers digests of what follows it, at the lengths that names of its table have, so
    names and references meet on an equality, a long name costs its own table alone, and texts are not carried along.
    """
    known = names.select("table_id", F.lower("name").alias("name_key"), "column_id", "name", "position").where(F.length("name_key") > 0)
    first = known.groupBy("table_id", F.length("name_key").alias("n"), _digest(F.col("name_key")).alias("digest")).agg(
        F.min(F.struct("position", "column_id", "name")).alias("c"))
    sizes = first.groupBy("table_id").agg(F.collect_set("n").alias("sizes"))  # as many as the longest name has characters, at most
    marked = texts.where(F.contains("text", F.lit("@"))).join(sizes, "table_id", "left")
    starts = marked.select("text_id", "table_id", "text", "sizes", F.explode(_starts(F.col("text"))).alias("start_at"))
    refs = cut(starts.select(
        "text_id", "table_id", "start_at", _guess(F.col("text"), F.col("start_at")).alias("guess"),
        F.transform(F.filter("sizes", _ends_a_word), lambda n: F.struct(n.alias("n"), _digest(F.lower(F.substring(F.col("text"), F.col("start_at") + 1, n))).alias("digest"))).alias("offers")))
    met = refs.select("text_id", "table_id", "start_at", F.explode("offers").alias("o")).select("text_id", "table_id", "start_at", "o.n", "o.digest").join(
        first, ["table_id", "n", "digest"]).groupBy("text_id", "start_at").agg(F.max(F.struct("n", "c.column_id", "c.name")).alias("m"))
    spelt = met.join(texts.select("text_id", "text"), "text_id").select("text_id", "start_at", "m", F.substring(F.col("text"), F.col("start_at") + 1, F.col("m.n")).alias("spelt"))
    return refs.join(spelt, ["text_id", "start_at"], "left").select(
        "text_id", "table_id", "start_at", F.coalesce("spelt", "guess").alias("raw"), F.col("m.column_id").alias("resolved_id"), F.col("m.name").alias("resolved_name"),
    ).where("resolved_id is not null or raw <> ''")


def _digest(name: Column) -> Column:
    return F.unhex(F.md5(name))


def _ends_a_word(n: Column) -> Column:
    """Whether the text goes on for n characters after the mark and the next one is no letter or digit."""
    after = F.substring(F.col("text"), F.col("start_at") + 1 + n, F.lit(1))
    return (F.length("text") >= F.col("start_at") + n) & ~F.rlike(after, F.lit(r"(?U)\w"))


def referenced_names(refs: DataFrame) -> DataFrame:
    """Per text, resolved names and unresolved tokens, each once, in order of first use."""
    def ordered(value: str, keep: Column) -> Column:
        rows = F.sort_array(F.collect_list(F.when(keep, F.struct("start_at", value))))
        return F.array_distinct(F.transform(rows, lambda r: r[value]))

    return refs.groupBy("text_id").agg(
        ordered("resolved_name", F.col("resolved_id").isNotNull()).alias("resolved"),
        ordered("raw", F.col("resolved_id").isNull()).alias("unresolved"),
    )
