"""Label and name normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specaudit import vocab


# What (?U)\s matches: tab to carriage return, and the separators of Unicode.
_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space at both ends; a pattern would look at every run of it inside a long text."""
    return F.trim(c, F.lit(_SPACE))


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_name(c: Column) -> Column:
    """The key under which two spellings of a name are the same name."""
    return F.lower(squeeze(c))


def fold_label(c: Column) -> Column:
    return F.lower(F.trim(c))


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def native_type_of(c: Column) -> Column:
    return F.coalesce(literal_map(vocab.NATIVE_TYPE_ALIASES)[F.lower(F.trim(c))], F.trim(c))


def failure_class_of(c: Column) -> Column:
    """An alias's class, else the slug of what was written; blank is null."""
    key = F.lower(F.trim(c))
    slug = F.translate(key, "/- ", "___")
    return F.when(key != "", F.coalesce(literal_map(vocab.failure_class_aliases())[key], slug))


def dimension_of(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), "- ", "__")


def normalise_native_type(df: DataFrame, column: str) -> DataFrame:
    value = native_type_of(F.col(column))
    return df.select("*", value.alias("value"), value.isin(vocab.NATIVE_TYPES).alias("valid"))


def normalise_failure_class(df: DataFrame, column: str) -> DataFrame:
    value = failure_class_of(F.col(column))
    return df.select("*", value.alias("value"), value.isin(list(vocab.FAILURE_CLASSES)).alias("valid"))


def normalise_dimension(df: DataFrame, column: str) -> DataFrame:
    value = dimension_of(F.col(column))
    known = [key for key, _ in vocab.COVERAGE_DIMENSIONS]
    return df.select("*", value.alias("value"), value.isin(known).alias("valid"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def set_hash(ids: Column) -> Column:
    """Digest of a set held in one row; sets spread over rows use `fingerprint` instead."""
    return F.substring(F.sha2(F.array_join(F.array_sort(ids), "\n"), 256), 1, 16)


def fingerprint(c: Column) -> Column:
    """Order-free digest of a set spread over rows: partial sums combine in any order."""
    part = F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return F.sum(part).cast("string")


def json_columns(df: DataFrame, column: str, schema: str) -> DataFrame:
    return df.withColumn(column, F.from_json(column, schema))
