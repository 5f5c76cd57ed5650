"""Version histories, ingest of submissions, change events and standards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specaudit import vocab
from specaudit.functions.normalise import fold_label, literal_array, native_type_of, norm_name, squeeze
from specaudit.functions.text import mark_positions

_STANDARD_FIELDS = ["vocabulary", "date_pattern", "currency_pattern", "evidence_boundary", "naming_rules"]
_CONSTRAINED = ["vocabulary", "date_pattern", "currency_pattern", "evidence_boundary"]


def standard_carry_forward(rows: DataFrame) -> DataFrame:
    """Every version of a scope with omitted fields taken from the version before."""
    w = Window.partitionBy("scope", "matter_id").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("scope", "matter_id", "version", *[F.last(f, ignorenulls=True).over(w).alias(f) for f in _STANDARD_FIELDS])


def _current(carried: DataFrame, scope: str) -> DataFrame:
    row = F.struct("version", *_STANDARD_FIELDS)
    return carried.where(F.col("scope") == scope).groupBy("matter_id").agg(F.max_by(row, "version").alias("r")).select("matter_id", "r.*")


def _both(matters: DataFrame, carried: DataFrame) -> DataFrame:
    """Each matter with the one baseline row, read as a scalar, and its own overlay."""
    firm = _current(carried, "firm").select(F.struct("version", *_STANDARD_FIELDS).alias("f"))
    own = _current(carried, "matter").select(
        "matter_id", F.col("version").alias("matter_version"), *[F.col(f).alias(f"own_{f}") for f in _STANDARD_FIELDS])
    row = matters.select("matter_id").withColumn("f", firm.scalar()).join(own, "matter_id", "left")
    return row.withColumns({"firm_version": F.col("f.version"), **{f"firm_{f}": F.col(f"f.{f}") for f in _STANDARD_FIELDS}}).drop("f")


def effective_standard(matters: DataFrame, carried: DataFrame) -> DataFrame:
    """The baseline with each matter's overlay: constrained fields only fill gaps, the rest replace."""
    default = F.lit("|".join(vocab.FALLBACK_VOCABULARY))
    both = _both(matters, carried).withColumn("firm_vocabulary", F.coalesce("firm_vocabulary", default))
    clash = [
        F.when(F.col(f"own_{f}").isNotNull() & F.col(f"firm_{f}").isNotNull() & (F.col(f"own_{f}") != F.col(f"firm_{f}")), F.lit(f))
        for f in _CONSTRAINED
    ]
    return both.select(
        "matter_id", "firm_version", "matter_version",
        *[F.coalesce(f"firm_{f}", f"own_{f}").alias(f) for f in _CONSTRAINED],
        F.coalesce("own_naming_rules", "firm_naming_rules").alias("naming_rules"),
        F.array_compact(F.array(*clash)).alias("overridden"),
    )


def standard_conflicts(matters: DataFrame, carried: DataFrame) -> DataFrame:
    """Fields where an overlay differs from the baseline, and a baseline vocabulary off the fixed list."""
    both = _both(matters, carried)
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"firm_{f}").alias("firm_value"), F.col(f"own_{f}").alias("matter_value")) for f in _CONSTRAINED])
    overlay = both.select("matter_id", F.inline(fields)).where("firm_value is not null and matter_value is not null and firm_value <> matter_value").select(
        "matter_id", F.lit("STANDARD_CONTRADICTS_FIRM").alias("code"), "field", "firm_value", "matter_value")
    fixed = "|".join(vocab.FALLBACK_VOCABULARY)
    firm = carried.where("scope = 'firm' and vocabulary is not null").where(F.col("vocabulary") != fixed).select(
        F.lit(0).cast("bigint").alias("matter_id"), F.lit("STANDARD_VOCABULARY_NOT_SKILL").alias("code"), F.lit("vocabulary").alias("field"),
        F.col("vocabulary").alias("firm_value"), F.lit(None).cast("string").alias("matter_value"))
    return overlay.unionByName(firm)


def next_version(changes: DataFrame) -> DataFrame:
    """Numbers for a column's text changes: v1.0 first, then the next minor, or the next major at minor 0.

    `changes`: column_id, change_no (order), bump ('minor' or 'major').
    """
    w = Window.partitionBy("column_id").orderBy("change_no")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(w) == 1
    raises = (F.when(first, 1).when(F.col("bump") == "major", 1).otherwise(0))
    numbered = changes.withColumn("raises", raises).withColumn("major", F.sum("raises").over(up))
    inside = Window.partitionBy("column_id", "major").orderBy("change_no")
    out = numbered.withColumn("minor", F.row_number().over(inside) - 1)
    return out.select(
        "column_id", "change_no", F.col("major").cast("bigint").alias("major"), F.col("minor").cast("bigint").alias("minor"),
        F.concat(F.lit("v"), F.col("major"), F.lit("."), F.col("minor")).alias("version"))


def name_duplicates(batch: DataFrame) -> DataFrame:
    """Later records that repeat a name of their table. `batch`: table_id, seq, name, position, ..."""
    w = Window.partitionBy("table_id", "name_key").orderBy("seq")
    keyed = batch.withColumn("name_key", norm_name(F.col("name")))
    return keyed.withColumn("rn", F.row_number().over(w)).where("rn > 1").select("table_id", "seq", "name")


def position_duplicates(batch: DataFrame) -> DataFrame:
    """Records whose position an earlier, differently named record already holds, naming the first holder."""
    keyed = batch.withColumn("name_key", norm_name(F.col("name")))
    holder = keyed.groupBy("table_id", "position").agg(F.min(F.struct("seq", "name")).alias("first"))
    once = keyed.groupBy("table_id", "name_key").agg(F.min("seq").alias("seq"))
    return keyed.join(once, ["table_id", "name_key", "seq"]).join(holder, ["table_id", "position"]).where("seq > first.seq").select(
        "table_id", "seq", "position", "name", F.col("first.name").alias("first_name"))


def validate_submission(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted records with folded labels, findings per record).

    A record with a missing or unknown type, status or role, or with a repeated name, is not accepted.
    """
    folded = batch.withColumns({
        "name": squeeze(F.col("name")),
        "native_type": F.when(F.trim("native_type") != "", native_type_of(F.col("native_type"))),
        "status": F.nullif(fold_label(F.col("status")), F.lit("")), "role": F.nullif(fold_label(F.col("role")), F.lit("")),
    })
    c, empty = F.col, F.array().cast("array<string>")
    options = F.transform(F.coalesce("options", empty), lambda o: F.trim(o))
    low = F.transform(options, F.lower)
    classify = F.coalesce(c("native_type") == "Classify", F.lit(False))
    malformed = F.exists(options, lambda o: o == "") | (F.size(F.array_distinct(low)) != F.size(low))
    rules = {
        "NATIVE_TYPE_MISSING": c("native_type").isNull(),
        "NATIVE_TYPE_INVALID": c("native_type").isNotNull() & ~c("native_type").isin(vocab.NATIVE_TYPES),
        "OPTIONS_MISSING": classify & (F.size(options) == 0),
        "OPTIONS_MALFORMED": classify & (F.size(options) > 0) & malformed,
        "OPTIONS_ON_NON_CLASSIFY": ~classify & (F.size(options) > 0),
        "STATUS_INVALID": c("status").isNotNull() & ~c("status").isin(vocab.COLUMN_STATUSES),
        "ROLE_INVALID": c("role").isNotNull() & ~c("role").isin(vocab.COLUMN_ROLES),
    }
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in rules.items()]))
    judged = folded.withColumn("codes", codes)
    repeated = name_duplicates(judged).select("table_id", "seq").withColumn("repeated", F.lit(True))
    fatal = literal_array(["NATIVE_TYPE_MISSING", "NATIVE_TYPE_INVALID", "STATUS_INVALID", "ROLE_INVALID"])
    accepted = judged.where(~F.arrays_overlap("codes", fatal)).join(repeated, ["table_id", "seq"], "left_anti").drop("codes")
    findings = (
        judged.select("table_id", "seq", "name", F.explode("codes").alias("code"))
        .unionByName(name_duplicates(judged).withColumn("code", F.lit("COLUMN_NAME_DUPLICATE")))
        .unionByName(position_duplicates(judged).select("table_id", "seq", "name", F.lit("POSITION_DUPLICATE").alias("code")))
    )
    return accepted, findings


def merge_columns(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """One row per column after an ingest, with what happened to it.

    `stored`: table_id, column_id, name, position, native_type, status, role, text, minor (current).
    `batch`: table_id, name, position, native_type, status, role, text; already validated. A changed
    text takes the next minor version; a column the batch leaves out stays as it is and is reported.
    """
    old = stored.select(
        "table_id", norm_name(F.col("name")).alias("name_key"), "column_id", F.col("name").alias("o_name"), F.col("position").alias("o_position"),
        F.col("native_type").alias("o_type"), F.col("status").alias("o_status"), F.col("role").alias("o_role"), F.col("text").alias("o_text"), "minor",
        F.lit(True).alias("known"))
    new = batch.select(
        "table_id", norm_name(F.col("name")).alias("name_key"), "name", "position", "native_type", "status", "role", "text", F.lit(True).alias("sent"))
    row = new.join(old, ["table_id", "name_key"], "full")
    c = F.col
    sent, known = c("sent").isNotNull(), c("known").isNotNull()
    changed = ~c("o_text").eqNullSafe(c("text"))
    action = (
        F.when(~sent & (c("o_status") == "retired"), "retired").when(~sent, "absent").when(~known, "created")
        .when(changed, "version").otherwise("unchanged"))
    revived = F.when(c("o_status") == "retired", "draft").otherwise(c("o_status"))
    minor = F.when(~known | (sent & c("minor").isNull()), 0).when(sent & changed, c("minor") + 1).otherwise(c("minor"))
    return row.select(
        "table_id", "name_key", "column_id", F.coalesce("name", "o_name").alias("name"),
        F.when(sent, c("position")).otherwise(c("o_position")).alias("position"),
        F.when(sent, c("native_type")).otherwise(c("o_type")).alias("native_type"),
        F.when(sent, F.coalesce(c("status"), revived, F.lit("draft"))).otherwise(c("o_status")).alias("status"),
        F.coalesce("role", "o_role").alias("role"),
        F.when(sent, c("text")).otherwise(c("o_text")).alias("text"),
        minor.cast("bigint").alias("minor"), action.alias("action"),
    )


def merge_instructions(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """One row per table after new instructions: a new version only where the text differs."""
    new = batch.select("table_id", F.col("text").alias("n_text"), F.lit(True).alias("sent"))
    row = stored.select("table_id", "version", "text").join(new, "table_id", "full")
    c = F.col
    changed = c("sent").isNotNull() & ~c("text").eqNullSafe(c("n_text"))
    action = F.when(c("version").isNull(), "created").when(changed, "version").when(c("sent").isNotNull(), "unchanged").otherwise("kept")
    return row.select(
        "table_id", (F.coalesce("version", F.lit(0)) + changed.cast("int")).cast("bigint").alias("version"),
        F.when(changed, c("n_text")).otherwise(c("text")).alias("text"), action.alias("action"))


_CHANGED = ["name", "status", "role", "concept", "native_type"]


def apply_changes(columns: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns after a batch of change events, new text versions, change log).

    `events`: column_id, change_no, name, status, role, concept, native_type, text, bump, note; a null
    field is left alone. `change_no` is any ordered key without repeats in a column. The last value of each field wins. A change of text is logged once as a
    version; a change without new text is logged as a revision, or as a retirement.
    """
    log_order = Window.partitionBy("column_id").orderBy("change_no")
    base = columns.where("text is not null").select("column_id", F.lit(None).cast(events.schema["change_no"].dataType).alias("change_no"), "text")
    texts = events.where("text is not null").select("column_id", "change_no", "text").unionByName(base)  # null comes first
    fresh = texts.withColumn("before", F.lag("text").over(log_order)).where("change_no is not null").where(~F.col("before").eqNullSafe(F.col("text")))
    versions = fresh.select("column_id", "change_no", "text").join(events.select("column_id", "change_no", "bump", "note"), ["column_id", "change_no"])
    last = events.groupBy("column_id").agg(*[
        F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("change_no"))).alias(f"n_{f}") for f in [*_CHANGED, "text"]])
    after = columns.join(last, "column_id", "left")
    updated = after.select("column_id", *[F.coalesce(f"n_{f}", f).alias(f) for f in [*_CHANGED, "text"]])
    meta = F.coalesce(*[F.col(f).cast("string") for f in _CHANGED]).isNotNull()
    marked = events.join(versions.select("column_id", "change_no", F.lit(True).alias("new_text")), ["column_id", "change_no"], "left")
    actions = F.array_compact(F.array(
        F.when(F.col("name").isNotNull(), F.lit("rename")),
        F.when(F.col("new_text"), F.lit("version")),
        F.when(F.col("new_text").isNull() & meta, F.when(F.col("status") == "retired", "retire").otherwise("revise")),
    ))
    log = marked.select("column_id", "change_no", F.explode(actions).alias("action"), "note")
    return updated, versions, log


def stale_name_mentions(renames: DataFrame, prompts: DataFrame, names: DataFrame) -> DataFrame:
    """Current prompts that still reference `@OldName` of their own table after a rename.

    `renames`: table_id, column_id, old_name, new_name. `prompts`: table_id, column_id, text.
    """
    r = renames.select("table_id", F.col("column_id").alias("renamed_id"), F.lower("old_name").alias("key"), "old_name", "new_name")
    sizes = r.select("table_id", F.length("key").alias("size")).distinct()
    texts = prompts.where(F.contains("text", F.lit("@"))).select("table_id", "column_id", F.lower("text").alias("low"))
    # What follows each mark, at the lengths that renamed names of the table have, meets the names on an equality.
    offered = texts.join(sizes, "table_id").select(
        "table_id", "column_id", F.explode(F.array_distinct(F.transform(mark_positions(F.col("low"), "@"), lambda at: F.substring(F.col("low"), at + 1, F.col("size"))))).alias("key"))
    live = names.where("status <> 'retired'").select("column_id")
    return offered.distinct().join(r, ["table_id", "key"]).where(F.col("column_id") != F.col("renamed_id")).join(live, "column_id", "left_semi").select(
        "column_id", "renamed_id", "old_name", "new_name")
