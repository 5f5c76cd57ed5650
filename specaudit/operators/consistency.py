"""Definitions that drift apart across the tables of a matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specaudit import vocab
from specaudit.functions import text as T
from specaudit.functions.normalise import literal_map
from specaudit.operators.graph import components
from specaudit.operators.patterns import candidates
from specaudit.operators.similarity import similar_sets


def dep_on_retired(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    s = vertices.where("status = 'retired'").select(F.col("column_id").alias("src"))
    d = vertices.where("status <> 'retired'").select(F.col("column_id").alias("dst"))
    return edges.join(s, "src", "left_semi").join(d, "dst", "left_semi").select("src", "dst", "kind")


def role_order(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges whose source belongs to a later stage than the column that reads it."""
    rank = literal_map({r: str(i) for i, r in enumerate(vocab.COLUMN_ROLES)})
    ranked = vertices.where("role is not null").select("column_id", "role", "status", rank[F.col("role")].cast("int").alias("stage"))
    s = ranked.select(F.col("column_id").alias("src"), F.col("role").alias("src_role"), F.col("stage").alias("s"))
    d = ranked.where("status <> 'retired'").select(F.col("column_id").alias("dst"), F.col("role").alias("dst_role"), F.col("stage").alias("d"))
    return edges.join(s, "src").join(d, "dst").where("s > d").select("src", "dst", "kind", "src_role", "dst_role")


def control_plane(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Narrative columns that two or more live columns of their table read."""
    s = vertices.where((F.col("status") != "retired") & F.col("native_type").isin(vocab.NARRATIVE_TYPES)).select(F.col("column_id").alias("src"))
    d = vertices.where("status <> 'retired'").select(F.col("column_id").alias("dst"))
    inside = edges.where("kind = 'intra_table_ref'").join(s, "src", "left_semi").join(d, "dst", "left_semi")
    return inside.groupBy(F.col("src").alias("column_id")).agg(F.countDistinct("dst").alias("dependents")).where("dependents >= 2")


def instructions_missing(tables: DataFrame, columns: DataFrame, instructions: DataFrame) -> DataFrame:
    used = columns.where("status <> 'retired'").select("table_id").distinct()
    return tables.select("matter_id", "table_id").join(used, "table_id", "left_semi").join(instructions, "table_id", "left_anti")


def instructions_vocabulary(instructions: DataFrame, terms: list[str]) -> DataFrame:
    row = instructions.select("table_id", "version", T.vocabulary_missing(F.col("text"), terms).alias("missing"))
    return row.where(F.size("missing") > 0)


def entity_variants(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """Differently printed entity names per text. `entities`: matter_id, name.

    Every printed form holds the words of the name, so a text and a name meet only if the text holds the longest of them.
    """
    fold = lambda c: F.lower(F.upper(c))
    words = F.split(T.split_entity(F.col("name"))["base"], r"(?U)\s+")
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    named = entities.select("matter_id", F.col("name").alias("standard_name")).distinct()
    keyed = entities.select(
        F.col("matter_id").alias("group_id"), F.xxhash64("name").alias("value_id"), fold(longest).alias("value")).distinct()
    places = texts.withColumn("text_id", F.xxhash64("table_id", "column_id", "site", "text"))
    met = candidates(places.select(F.col("matter_id").alias("group_id"), "text_id", fold(F.col("text")).alias("body")), keyed)
    row = met.select(F.col("group_id").alias("matter_id"), "text_id", "value_id").join(places, ["matter_id", "text_id"]).join(
        named.withColumn("value_id", F.xxhash64("standard_name")), ["matter_id", "value_id"])
    return row.select(
        "matter_id", "table_id", "column_id", "site", "standard_name",
        F.explode(T.entity_forms(F.col("text"), F.col("standard_name"))).alias("variant"),
    )


def _divergence(found: DataFrame, standard: DataFrame, value: str) -> DataFrame:
    """Values in use that differ from the matter's standard, or all of them when none is set and they differ.

    `found`: matter_id, site_key, value, n. Sites are counted, never listed in one row.
    """
    per = found.groupBy("matter_id", value).agg(F.sum("n").alias("n_samples"), F.count("*").alias("n_sites"))
    width = per.groupBy("matter_id").agg(F.count("*").alias("values_in_use"))
    row = per.join(width, "matter_id").join(standard, "matter_id", "left")
    clash = F.when(F.col("standard").isNotNull(), F.col(value) != F.col("standard")).otherwise(F.col("values_in_use") > 1)
    return row.where(clash).select("matter_id", F.col(value).alias("pattern"), "standard", "n_samples", "n_sites")


def _site(found: DataFrame, value: str) -> DataFrame:
    return found.groupBy("matter_id", "table_id", "column_id", value).agg(F.count("*").alias("n"))


def date_divergence(texts: DataFrame, standards: DataFrame) -> DataFrame:
    hit = texts.select("matter_id", "table_id", "column_id", F.explode(T.date_pattern_tokens(F.col("text"))).alias("token"))
    return _divergence(_site(hit, "token"), standards.select("matter_id", F.col("date_pattern").alias("standard")), "token")


def currency_divergence(texts: DataFrame, standards: DataFrame) -> DataFrame:
    hit = texts.select("matter_id", "table_id", "column_id", F.explode(T.currency_samples(F.col("text"))).alias("sample"))
    styled = hit.withColumn("style", T.currency_style(F.col("sample")))
    standard = standards.select("matter_id", T.currency_style(F.col("currency_pattern")).alias("standard"))
    return _divergence(_site(styled, "style"), standard, "style")


def described_columns(vertices: DataFrame, columns: DataFrame, prompts: DataFrame) -> DataFrame:
    """Active columns that have a prompt, with what their definition amounts to."""
    concept = F.nullif(F.lower(F.trim("concept")), F.lit(""))
    extra = columns.select("column_id", concept.alias("concept"), "options")
    text = prompts.select("column_id", F.array_join(T.fallback_terms_used(F.col("text")), "|").alias("fallbacks"))
    return (
        vertices.where("status <> 'retired'").join(extra, "column_id").join(text, "column_id")
        .select("matter_id", "table_id", "column_id", "name", F.lower(F.trim("name")).alias("name_key"),
                "native_type", "role", "concept", "options", "fallbacks")
    )


def _spread(described: DataFrame, key: str) -> DataFrame:
    return described.groupBy("matter_id", key).agg(
        F.count("*").alias("members"), F.countDistinct("table_id").alias("tables"),
        F.countDistinct("name").alias("names"), F.countDistinct("native_type").alias("types"),
        F.countDistinct("options").alias("option_sets"), F.countDistinct("fallbacks").alias("fallback_sets"),
        F.count("concept").alias("tagged"), F.countDistinct("concept").alias("concepts"),
    )


def concept_divergence(described: DataFrame) -> DataFrame:
    return _spread(described.where("concept is not null"), "concept").select(
        "matter_id", "concept", "members", "tables", "types", "option_sets", "fallback_sets")


def concept_name_variant_tagged(described: DataFrame) -> DataFrame:
    """One concept under several column names, in at least two tables."""
    return _spread(described.where("concept is not null"), "concept").where("tables >= 2 and names > 1").select(
        "matter_id", "concept", "names", "members", "tables")


def concept_divergent_rules(described: DataFrame) -> DataFrame:
    """One concept, or one name not settled by a shared concept, with different definitions across tables."""
    differs = "tables >= 2 and (types > 1 or option_sets > 1 or fallback_sets > 1)"
    shared = ["matter_id", "basis", "key", "members", "types", "option_sets", "fallback_sets"]
    by_concept = _spread(described.where("concept is not null"), "concept").where(differs).select(
        "*", F.lit("concept").alias("basis"), F.col("concept").alias("key")).select(*shared)
    by_name = _spread(described, "name_key").where(differs).where("not (tagged = members and concepts = 1)").select(
        "*", F.lit("name").alias("basis"), F.col("name_key").alias("key")).select(*shared)
    return by_concept.unionByName(by_name)


def option_overlap(described: DataFrame) -> DataFrame:
    """Per divergent name: each option, how many members have it, and whether all of them do."""
    members = described.where("options is not null").select(
        "matter_id", "name_key", "column_id", F.explode(F.array_distinct(F.split("options", r"\|"))).alias("option"))
    size = described.where("options is not null").groupBy("matter_id", "name_key").agg(
        F.count("*").alias("members"), F.countDistinct(F.array_join(F.array_sort(F.array_distinct(F.split("options", r"\|"))), "|")).alias("distinct_sets"))
    per = members.groupBy("matter_id", "name_key", "option").agg(F.count("*").alias("holders"))
    return per.join(size.where("distinct_sets > 1"), ["matter_id", "name_key"]).select(
        "matter_id", "name_key", "option", "holders", "members", "distinct_sets", (F.col("holders") == F.col("members")).alias("shared"))


def tagging_progress(vertices: DataFrame, columns: DataFrame) -> DataFrame:
    live = vertices.where("status <> 'retired'").select("matter_id", "column_id").join(columns.select("column_id", "concept"), "column_id")
    return live.groupBy("matter_id").agg(F.count("concept").alias("tagged"), F.count("*").alias("total"))


def candidate_names(described: DataFrame) -> DataFrame:
    """Distinct names of a matter that are not fully tagged, with their tokens."""
    per = described.groupBy("matter_id", F.col("name_key").alias("id")).agg(
        F.count_if(F.col("concept").isNull()).alias("untagged"))
    return per.where("untagged > 0").select("matter_id", "id", T.name_tokens(F.col("id")).alias("tokens"))


def similar_name_links(candidates: DataFrame) -> DataFrame:
    wide = candidates.where(F.size("tokens") >= 2).select("matter_id", "id", F.array_sort("tokens").alias("tokens"))
    return similar_sets(wide, ["matter_id"], vocab.NAME_SIMILARITY)


def name_clusters(links: DataFrame) -> DataFrame:
    """(matter_id, name, cluster): linked names, transitively; the cluster is its smallest name."""
    def node(c: str) -> Column:
        return F.concat_ws("/", F.col("matter_id").cast("string"), c)

    parts = components(links.select(node("a").alias("src"), node("b").alias("dst")))
    def split(c: str, n: int) -> Column:
        return F.substring_index(c, "/", 1).cast("bigint") if n == 0 else F.expr(f"substring({c}, locate('/', {c}) + 1)")

    return parts.select(split("node", 0).alias("matter_id"), split("node", 1).alias("name"), split("component", 1).alias("cluster"))


def name_cluster_confidence(clusters: DataFrame, links: DataFrame, described: DataFrame) -> DataFrame:
    """Clusters found in two tables or more, graded strong, or possible with the reasons."""
    size = clusters.groupBy("matter_id", "cluster").agg(F.count("*").alias("names"))
    linked = links.join(clusters.withColumnRenamed("name", "a"), ["matter_id", "a"]).groupBy("matter_id", "cluster").agg(F.count("*").alias("links"))
    tokens = clusters.select("matter_id", "cluster", F.explode(T.name_tokens(F.col("name"))).alias("token")).where(
        F.col("token").isin(vocab.NAME_QUALIFIERS)).groupBy("matter_id", "cluster", "token").agg(F.count("*").alias("n"))
    marks = tokens.join(size, ["matter_id", "cluster"]).where("n < names").select("matter_id", "cluster").distinct().withColumn("qualified", F.lit(True))
    cols = described.join(clusters.withColumnRenamed("name", "name_key"), ["matter_id", "name_key"]).groupBy("matter_id", "cluster").agg(
        F.countDistinct("table_id").alias("tables"),
        F.bool_or(F.col("role") == "orientation").alias("oriented"), F.bool_or(F.col("role") != "orientation").alias("other"),
    )
    row = size.join(linked, ["matter_id", "cluster"]).join(cols, ["matter_id", "cluster"]).join(marks, ["matter_id", "cluster"], "left")
    n = F.col("names")
    reasons = F.array_compact(F.array(
        F.when(F.col("links") < n * (n - 1) / 2, F.lit("joined transitively")),
        F.when(F.col("qualified"), F.lit("qualifier")),
        F.when(F.col("oriented") & F.col("other"), F.lit("orientation")),
    ))
    return row.where("names >= 2 and tables >= 2").select(
        "matter_id", "cluster", "names", "links", "tables",
        F.when(F.size(reasons) > 0, "possible").otherwise("strong").alias("confidence"), reasons.alias("reasons"),
    )


def variant_rank(graded: DataFrame) -> DataFrame:
    return graded.orderBy(F.col("confidence") != "strong", F.desc("names"), "cluster", "matter_id")


def heuristic_precision(graded: DataFrame, labels: DataFrame) -> DataFrame:
    """How often a grade agrees with the label of its cluster; unclear ones do not count.

    `labels`: matter_id, cluster, label (same / different / unclear).
    """
    row = graded.join(labels.where("label <> 'unclear'"), ["matter_id", "cluster"])
    strong, same = F.col("confidence") == "strong", F.col("label") == "same"
    return row.agg(
        F.avg(F.when(strong, same.cast("int"))).alias("strong_precision"),
        F.avg(F.when(~strong, (~same).cast("int"))).alias("possible_precision"),
        F.avg((strong == same).cast("int")).alias("graded_correctly"),
    )


def concept_tagging(columns: DataFrame, vertices: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns with the assigned concepts, assignments that match nothing).

    `assignments`: matter_id, table_key (null for every table), name_key, concept. A named table wins.
    """
    live = vertices.where("status <> 'retired'").select(
        "matter_id", "column_id", F.lower(F.trim("table_name")).alias("table_key"), F.lower(F.trim("name")).alias("name_key"))
    wide = assignments.where("table_key is null").select("matter_id", "name_key", F.col("concept").alias("wide"), F.lit(True).alias("w"))
    exact = assignments.where("table_key is not null").select("matter_id", "table_key", "name_key", F.col("concept").alias("exact"), F.lit(True).alias("x"))
    hit = live.join(wide, ["matter_id", "name_key"], "left").join(exact, ["matter_id", "table_key", "name_key"], "left")
    tags = hit.where("w or x").select("column_id", F.when(F.col("x"), F.col("exact")).otherwise(F.col("wide")).alias("tag"), F.lit(True).alias("set"))
    tagged = columns.join(tags, "column_id", "left").withColumn(
        "concept", F.when(F.col("set"), F.nullif(F.trim("tag"), F.lit(""))).otherwise(F.col("concept"))).drop("tag", "set")
    lost = assignments.where("table_key is null").join(live, ["matter_id", "name_key"], "left_anti").unionByName(
        assignments.where("table_key is not null").join(live, ["matter_id", "table_key", "name_key"], "left_anti"))
    return tagged, lost

