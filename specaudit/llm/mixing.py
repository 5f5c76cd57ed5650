"""Mixing sources to target weights by hash thresholds: no row is sorted, and only boundary buckets are looked at again.

A document's key is a digest of its id and text. Sizes (words) are summed by source and by the first digits of the key, so
one bounded histogram per source tells in which bucket a budget ends: every key below that bucket is in, every key above
is out. The rows of the boundary bucket alone are summed again by the next digits, until one row is left, which gives the
rest of the budget. A source that is repeated has one budget per repetition; all are thresholds on the same keys, so they
are nested: what is taken a second time was taken once.

Targets: sources weigh `weights` in turn, by code point with null last, and share the sum of all sizes; none gets more than
`repeats` times its own size, and what is above is shared again among the others by weight until nothing is above. That is
a short loop over one aggregate of the table of sources, whose capped part only grows.

Scale: the texts are read once, for sizes and keys. Sums combine before each shuffle, so a source with a third of all rows
costs one row a bucket and task. The narrow rows meet the table of sources by an equi-join, which adaptive execution
broadcasts if it is small and splits where a source is hot; nothing is hinted. The driver sees one row of sums per round.

Edge cases: a null text or one without words has size 0 and is taken 0 times. A null source is a source of its own. Rows
that agree in source, id and text are told apart by their place in the written table, and since they are equal it makes
no difference which of them is taken: reruns agree. A null doc_id is an id like others. If no text has a word, all
targets are 0. No rows give no rows. Other columns are ignored, unless named in `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specaudit.session import cut

DIGITS = 3  # hexadecimal digits of the key per round: 4,096 buckets a source
WEIGHTS, REPEATS = (1, 2, 3), 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, key) of every row, written once; `key` is unique: 32 digits of the digest, 16 of the row's place."""
    text, doc = F.col("text").cast("string"), F.col("doc_id").cast("long")
    digest = F.md5(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    kept = [F.struct(*keep).alias("kept")] if keep else []
    written = cut(docs.select(doc.alias("doc_id"), F.col("source").cast("string").alias("source"), words(text).alias("size"), digest.alias("digest"), F.monotonically_increasing_id().alias("place"), *kept))
    return written.withColumn("key", F.concat("digest", F.reverse(F.lpad(F.hex("place"), 16, "0")))).drop("digest", "place")


def _bucket(at: str = "1") -> Column:
    return F.expr(f"substring(key, {at}, {DIGITS})")


def _numbered(sources: DataFrame) -> DataFrame:
    """With `rank`: the place of each source by code point, null last, without sorting in one task."""
    order = F.col("source").asc_nulls_last()
    placed = cut(sources.orderBy(order).withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    counts = placed.groupBy(part.alias("part")).count()  # one row a partition
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    return placed.withColumn("part", part).join(before, "part").withColumn("rank", F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1)).drop("id", "part", "before")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size)."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    weighed = cut(_numbered(sources).withColumn("weight", weight).select("source", "source_size", "weight"))
    most = F.col("source_size") * repeats
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    capped, rest, share = 0, total, None
    while True:  # a source is above its cap where weight * rest / share > most
        above = F.lit(False) if share is None else F.col("weight") * F.lit(rest).cast("decimal(38,0)") > most * F.lit(share).cast("decimal(38,0)")
        n, taken, left = weighed.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, most)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if share is not None and n == capped:
            break
        capped, rest, share = n, total - taken, left
        if not share:
            break
    if not share or not total:
        return weighed.select("source", "source_size", most.cast("double").alias("target"))
    fair = F.col("weight") * F.lit(rest).cast("double") / F.lit(float(share))
    return weighed.select("source", "source_size", F.when(above, most.cast("double")).otherwise(fair).alias("target"))


def thresholds(rows: DataFrame, histogram: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, step, bar, rest): a budget takes every key below `bar` and `rest` words of the row with that key.

    `rows`: source, size, key. `histogram`: source, bucket, size of the first digits. `budgets`: source, step, budget, each
    below the source's size.
    """
    keys = ["source", "step"]
    of = F.col("source").eqNullSafe(F.col("of"))
    sums, done, first = histogram.join(budgets, of).select(*keys, "bucket", "size", "budget"), [], True
    while True:
        up_to = F.sum("size").over(Window.partitionBy(*keys).orderBy("bucket"))
        ends = sums.withColumn("up_to", up_to).where("up_to - size <= budget and budget < up_to").select(
            F.col("source").alias("of"), F.col("step").alias("at"), F.col("bucket").alias("bar"), (F.col("budget") - F.col("up_to") + F.col("size")).alias("budget"))
        same = of & (_bucket() == F.col("bar")) if first else of & (F.col("step") == F.col("at")) & (_bucket("digit") == F.col("bar"))
        rows = cut(rows.where("size > 0").join(cut(ends), same).select("source", F.col("at").alias("step"), "size", "key", "budget"))
        counted = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.min("key").alias("bar"), F.max("key").alias("high"), F.min("budget").alias("rest"))
        done.append(counted.where("rows = 1").select(*keys, "bar", "rest"))  # a bucket is settled once it holds one row
        # The next digits are those from the first in which the keys of the bucket differ.
        differ = F.expr("filter(sequence(1, length(bar)), i -> substring(bar, i, 1) <> substring(high, i, 1))[0]")
        many = cut(counted.where("rows > 1").select(F.col("source").alias("of"), F.col("step").alias("at"), differ.alias("digit")))
        if many.isEmpty():
            break
        rows = cut(rows.join(many, of & (F.col("step") == F.col("at"))).select(*keys, "size", "key", "budget", "digit"))
        sums = rows.groupBy(*keys, _bucket("digit").alias("bucket")).agg(F.sum("size").alias("size"), F.min("budget").alias("budget"))
        rows, first = rows.drop("budget"), False
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies[, kept]) of every row of (doc_id, source, text).

    `taken` counts words: `copies` whole texts and, of one row a source, the words left of its target.
    """
    rows = sized(docs, keep)
    histogram = cut(rows.groupBy("source", _bucket().alias("bucket")).agg(F.sum("size").alias("size")))
    targets = cut(source_targets(histogram.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats))
    # Repetition k of a source has the budget that the earlier ones leave; whole and empty ones need no threshold.
    step = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("step")
    budget = F.round("target").cast("long") - F.col("step") * F.col("source_size")
    partial = targets.select(F.col("source").alias("of"), "source_size", "target", step).withColumn("budget", budget).where("budget > 0 and budget < source_size")
    bars = cut(thresholds(rows, histogram, cut(partial.select("of", "step", "budget"))))
    bar = bars.groupBy(F.col("source").alias("of")).agg(F.first("bar").alias("bar"), F.first("rest").alias("rest"))  # one a source at most
    table = targets.join(bar, F.col("source").eqNullSafe(F.col("of")), "left").select(
        F.col("source").alias("of"), "source_size", "target", "bar", "rest",
        F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("whole"))
    below = F.coalesce((F.col("key") < F.col("bar")).cast("long"), F.lit(0))
    part = F.coalesce(F.when(F.col("key") == F.col("bar"), F.col("rest")), F.lit(0))
    out = rows.join(cut(table), F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + below).otherwise(F.lit(0).cast("long")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + part).alias("taken"), "source", "copies", *(["kept"] if keep else []))


def oracle_sql() -> str:
    """The same over `documents` with the weights 1, 2, 3 and three repetitions, sorting all keys."""
    return r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
-- Sources reach their caps in the order of size by weight; the first that does not ends the capped ones.
o AS (SELECT *, coalesce(sum(source_size) OVER before, 0) AS capped, sum(weight) OVER (ORDER BY source_size * 1.0 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share, sum(source_size) OVER () AS total
  FROM w WINDOW before AS (ORDER BY source_size * 1.0 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min_by(total - 3 * capped, source_size * 1.0 / weight) AS rest, min_by(share, source_size * 1.0 / weight) AS share FROM (SELECT * FROM o WHERE weight * (total - 3 * capped) <= 3 * source_size * share)),
t AS (SELECT w.source, source_size, CASE WHEN weight * rest > 3 * source_size * share THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight AS DOUBLE) * CAST(rest AS DOUBLE) / CAST(share AS DOUBLE) END AS target FROM w, f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS goal, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS before, d.source,
    CASE WHEN t.source_size > 0 THEN CAST(floor(round(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, least(size, greatest(0, goal - whole * source_size - before)) AS more FROM p)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN whole * size + more ELSE 0 END AS taken, source, CASE WHEN size = 0 THEN 0 ELSE whole + CAST(more = size AS BIGINT) END AS copies FROM q
"""
