"""The evaluation log: latest results, failures, run comparison and log audits.

A result is identified by (run, result_id, result_seq), which is also the order in which the
log was written; "latest" means greatest run start, then greatest identity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specaudit import vocab
from specaudit.functions.normalise import failure_class_of, fold_label, norm_name
from specaudit.operators.relational import active_columns

_LOG_ORDER = ["started_at", "run_id", "result_id", "result_seq"]
_PAYLOAD = ["passed", "raw_class", "raw_error_type"]


def normalise_log(log: DataFrame) -> DataFrame:
    return log.withColumns({
        "failure_class": failure_class_of(F.col("raw_class")),
        "error_type": fold_label(F.col("raw_error_type")),
    })


def _last(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last row per key as a max aggregate, so rows combine before they are shuffled.

    Labels are folded afterwards, on the rows that remain.
    """
    picked = [c for c in _LOG_ORDER + _PAYLOAD if c not in keys]
    last = log.groupBy(*keys).agg(F.max(F.struct(*picked)).alias("r")).select(*keys, "r.*")
    return normalise_log(last).drop("raw_class", "raw_error_type")


def latest_results(log: DataFrame) -> DataFrame:
    return _last(log, ["column_id", "document"])


def open_failures(latest: DataFrame) -> DataFrame:
    return latest.where(~F.col("passed"))


def last_result_in_run(log: DataFrame) -> DataFrame:
    return _last(log, ["run_id", "column_id", "document"])


def latest_run_per_table(runs: DataFrame) -> DataFrame:
    return runs.groupBy("table_id").agg(F.max(F.struct("started_at", "run_id")).alias("r")).select(
        "table_id", "r.run_id", "r.started_at"
    )


def last_run_per_column(snapshots: DataFrame) -> DataFrame:
    r = F.struct("started_at", "run_id", "prompt_version_id", "instructions_version_id")
    return snapshots.groupBy("column_id").agg(F.max(r).alias("r")).select("column_id", "r.*")


def two_latest_runs(runs: DataFrame) -> DataFrame:
    w = Window.partitionBy("table_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    ranked = runs.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    return (
        ranked.groupBy("table_id")
        .agg(
            F.max(F.when(F.col("rn") == 2, F.col("run_id"))).alias("earlier"),
            F.max(F.when(F.col("rn") == 1, F.col("run_id"))).alias("later"),
        )
        .where("earlier is not null")
    )


def run_snapshot_build(
    runs: DataFrame, columns: DataFrame, versions: DataFrame, instructions: DataFrame
) -> DataFrame:
    """Pin, for every recorded run, the prompt and instructions version each active column had then."""
    by_column = Window.partitionBy("column_id").orderBy("minor")
    prompts = (
        versions.select("column_id", "prompt_version_id", "minor", "version", "created_at")
        .withColumn("until", F.lead("created_at").over(by_column))
        .join(active_columns(columns).select("column_id", "table_id"), "column_id")
    )
    by_table = Window.partitionBy("table_id").orderBy("version")
    rules = instructions.select(
        F.col("table_id").alias("i_table"), "instructions_version_id",
        F.col("created_at").alias("i_from"),
        F.lead("created_at").over(by_table).alias("i_until"),
    )
    timed = runs.join(
        rules,
        (F.col("table_id") == F.col("i_table"))
        & (F.col("i_from") <= F.col("started_at"))
        & (F.col("i_until").isNull() | (F.col("started_at") < F.col("i_until"))),
        "left",
    ).select("run_id", "table_id", "started_at", "instructions_version_id")
    p = prompts.withColumnRenamed("table_id", "p_table")
    return timed.join(
        p,
        (F.col("table_id") == F.col("p_table"))
        & (F.col("created_at") <= F.col("started_at"))
        & (F.col("until").isNull() | (F.col("started_at") < F.col("until"))),
    ).select(
        "run_id", "table_id", "column_id", "started_at", "prompt_version_id",
        "instructions_version_id",
    )


def version_pin_join(snapshots: DataFrame, versions: DataFrame) -> DataFrame:
    v = versions.select("prompt_version_id", "version")
    return snapshots.join(v, "prompt_version_id").select("run_id", "column_id", "version")


def eval_version_default(log: DataFrame, pins: DataFrame) -> DataFrame:
    return log.join(pins, ["run_id", "column_id"], "left").withColumn(
        "effective_version", F.coalesce("cited_version", "version")
    )


def validate_eval(log: DataFrame, pins: DataFrame) -> DataFrame:
    """One row per rule a log row breaks; the log row itself is kept whatever it breaks."""
    c = F.col
    row = log.join(pins, ["run_id", "column_id"], "left")
    bad_class = c("failure_class").isNotNull() & ~c("failure_class").isin(list(vocab.FAILURE_CLASSES))
    bad_type = c("error_type").isNotNull() & ~c("error_type").isin(vocab.ERROR_TYPES)
    cited = F.lower(F.trim("cited_version"))
    rules = {
        "RUN_COLUMN_NOT_IN_SNAPSHOT": c("version").isNull(),
        "PROMPT_VERSION_MISMATCH": c("version").isNotNull() & c("cited_version").isNotNull() & (cited != F.lower("version")),
        "FAILURE_CLASS_INVALID": bad_class,
        "ERROR_TYPE_INVALID": bad_type,
        "FAILURE_FIELDS_ON_PASS": c("passed") & (c("failure_class").isNotNull() | c("error_type").isNotNull()),
        "FAILURE_CLASS_MISSING": ~c("passed") & c("failure_class").isNull(),
    }
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in rules.items()]))
    return row.select(
        "run_id", "column_id", "document", "result_id", "result_seq", F.explode(codes).alias("code")
    )


def batch_pass_fail(log: DataFrame) -> DataFrame:
    return log.groupBy("run_id").agg(
        F.count("*").alias("stored"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
    )


def column_eval_summary(columns: DataFrame, snapshots: DataFrame, latest: DataFrame) -> DataFrame:
    ran = snapshots.groupBy("column_id").agg(
        F.count("*").alias("runs"),
        F.max(F.struct("started_at", "run_id"))["run_id"].alias("last_run_id"),
    )
    tested = latest.groupBy("column_id").agg(
        F.count("*").alias("documents_tested"),
        F.count_if(~F.col("passed")).alias("open_failures"),
        F.sort_array(F.collect_set(F.when(~F.col("passed"), F.col("failure_class")))).alias("open_classes"),
    )
    zero = {"runs": 0, "documents_tested": 0, "open_failures": 0}
    return (
        columns.select("column_id").join(ran, "column_id", "left").join(tested, "column_id", "left")
        .fillna(zero)
    )


def _counted_failures(failures: DataFrame, vertices: DataFrame) -> DataFrame:
    """Open failures of active columns, counted per column and class before any wider grouping."""
    per = failures.groupBy("column_id", "failure_class").agg(F.count("*").alias("n"))
    return per.join(active_columns(vertices), "column_id").select(
        "matter_id", "table_id", "column_id", "failure_class", "n"
    )


def failures_summary(failures: DataFrame, vertices: DataFrame) -> DataFrame:
    """Open failures by class, by table and by column in one pass over grouping sets."""
    per = _counted_failures(failures, vertices).withColumn(
        "class_key", F.coalesce("failure_class", F.lit("(unclassified)"))
    )
    per = per.withColumns({"t": F.col("table_id"), "c": F.col("column_id"), "k": F.col("failure_class")})
    grouped = per.groupingSets(
        [["matter_id", "class_key"], ["matter_id", "table_id"], ["matter_id", "column_id"]],
        "matter_id", "class_key", "table_id", "column_id",
    ).agg(
        F.grouping_id().alias("gid"),
        F.sum("n").alias("failures"),
        F.countDistinct("t").alias("tables"),
        F.countDistinct("c").alias("columns"),
        F.countDistinct("k").alias("classes"),
    )
    return grouped.select(
        "matter_id",
        F.when(F.col("table_id").isNotNull(), "table").when(F.col("column_id").isNotNull(), "column")
        .otherwise("class").alias("grouping_name"),
        F.coalesce(F.col("table_id").cast("string"), F.col("column_id").cast("string"), "class_key").alias("key"),
        "failures", "tables", "columns", "classes",
    )


def recurring_failures(failures: DataFrame, vertices: DataFrame) -> DataFrame:
    """Classes open on three columns or more, or in two tables or more."""
    per = _counted_failures(failures, vertices).where("failure_class is not null")
    spread = per.groupBy("matter_id", "failure_class").agg(
        F.countDistinct("column_id").alias("columns"), F.countDistinct("table_id").alias("tables")
    )
    return spread.where("columns >= 3 or tables >= 2")


def run_results_outer(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """Results of each table's two runs side by side.

    Both sides come from one scan and meet in one aggregate, which is the full outer join without
    reading or shuffling the log twice.
    """
    side = pairs.select(
        "table_id", F.explode(F.array(
            F.struct(F.col("earlier").alias("run_id"), F.lit("a").alias("side")),
            F.struct(F.col("later").alias("run_id"), F.lit("b").alias("side")),
        )).alias("p"),
    ).select("table_id", "p.run_id", "p.side")
    last = last_result_in_run(log.join(side, "run_id", "left_semi")).join(side, "run_id")

    def pick(name: str, side_name: str):
        return F.max(F.when(F.col("side") == side_name, F.col(name))).alias(f"{side_name}_{name}")

    return last.groupBy("table_id", "column_id", "document").agg(
        pick("passed", "a"), pick("passed", "b"), pick("failure_class", "a"), pick("failure_class", "b")
    )


def run_compare(outer: DataFrame) -> DataFrame:
    a, b = F.col("a_passed"), F.col("b_passed")
    bucket = (
        F.when(a.isNull(), "only_in_later").when(b.isNull(), "only_in_earlier")
        .when(~a & b, "fixed").when(~a & ~b, "still_failing").when(a & ~b, "newly_failing")
        .otherwise("still_passing")
    )
    return outer.select("table_id", "column_id", "document", bucket.alias("bucket"), "a_failure_class", "b_failure_class")


def regressions(compared: DataFrame, pairs: DataFrame, pins: DataFrame) -> DataFrame:
    """Columns with documents that passed in the earlier run and fail in the later one."""
    hit = compared.where("bucket = 'newly_failing'").groupBy("table_id", "column_id").agg(
        F.sort_array(F.collect_list("document")).alias("documents")
    )
    before = pins.select(F.col("run_id").alias("earlier"), "column_id", F.col("version").alias("earlier_version"))
    after = pins.select(F.col("run_id").alias("later"), "column_id", F.col("version").alias("later_version"))
    return (
        hit.join(pairs, "table_id").join(before, ["earlier", "column_id"], "left")
        .join(after, ["later", "column_id"], "left")
        .select("table_id", "column_id", "documents", "earlier_version", "later_version")
    )


def unticked_dimensions(
    tables: DataFrame, runs: DataFrame, coverage: DataFrame
) -> DataFrame:
    """Applicable dimensions that the latest run of a table leaves unticked.

    The fourteen dimensions are a fixed list, so each table row repeats them in place.
    """
    dims = F.array(*[
        F.struct(F.lit(k).alias("dimension"), F.lit(g).alias("needs_grouping"))
        for k, g in vocab.COVERAGE_DIMENSIONS
    ])
    latest = latest_run_per_table(runs).join(tables.select("table_id", "grouping_enabled"), "table_id")
    wanted = (
        latest.select("table_id", "run_id", "grouping_enabled", F.inline(dims))
        .where(~F.col("needs_grouping") | F.col("grouping_enabled"))
        .select("table_id", "run_id", "dimension")
    )
    ticked = coverage.select("run_id", F.col("value").alias("dimension"))
    return wanted.join(ticked, ["run_id", "dimension"], "left_anti").select("table_id", "dimension", "run_id")


def dimension_gaps(unticked: DataFrame, tables: DataFrame, columns: DataFrame, sources: DataFrame) -> DataFrame:
    """Tables with unticked dimensions, and whether any assertion draws on the table."""
    per = unticked.groupBy("table_id", "run_id").agg(
        F.sort_array(F.collect_list("dimension")).alias("unticked")
    )
    sourcing = columns.join(sources, "column_id", "left_semi").select("table_id").distinct()
    n = len(vocab.COVERAGE_DIMENSIONS)
    return (
        per.join(tables.select("table_id", "matter_id", "grouping_enabled"), "table_id")
        .join(sourcing.withColumn("sources_assertion", F.lit(True)), "table_id", "left")
        .select(
            "matter_id", "table_id", "run_id", "unticked",
            F.when(F.col("grouping_enabled"), n).otherwise(n - 1).alias("applicable"),
            F.coalesce("sources_assertion", F.lit(False)).alias("sources_assertion"),
        )
    )


def inapplicable_dimensions(coverage: DataFrame, runs: DataFrame, tables: DataFrame) -> DataFrame:
    """Ticked dimensions that do not exist, or that the run's table cannot have."""
    grouped = {k for k, g in vocab.COVERAGE_DIMENSIONS if g}
    t = runs.select("run_id", "table_id").join(tables.select("table_id", "grouping_enabled"), "table_id")
    code = F.when(~F.col("valid"), "COVERAGE_DIMENSION_UNKNOWN").when(
        F.col("value").isin(list(grouped)) & ~F.col("grouping_enabled"), "COVERAGE_DIMENSION_NOT_APPLICABLE"
    )
    return (
        coverage.join(t, "run_id").withColumn("code", code).where("code is not null")
        .select("run_id", "table_id", F.col("raw_dimension").alias("dimension"), "code")
    )


def known_names(columns: DataFrame) -> DataFrame:
    return columns.select("table_id", norm_name(F.col("name")).alias("name_key"))
