"""Rule documents: parsing, audit and comparison of two editions.

A document is identified by (playbook_id, edition). Rules are rows; a document is never held whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specaudit import vocab
from specaudit.functions import text as T
from specaudit.functions.normalise import literal_map
from specaudit.operators.similarity import similar_sets
from specaudit.session import cut

DOC = ["playbook_id", "edition"]
_CHUNK = 4096  # blocks of one document that one window task orders
_GRAM = 6


def parse_rule_blocks(documents: DataFrame) -> DataFrame:
    """Markdown texts to ordered blocks; a line is a heading when it starts with hash marks."""
    heading = r"(?U)^#{1,6}\s+(.*)$"
    found = documents.select("playbook_id", F.posexplode(T.lines(F.col("text"))).alias("at", "line"))
    is_heading = F.col("line").rlike(r"(?U)^#{1,6}\s+")
    return found.select(
        "playbook_id", (F.col("at") + 1).cast("bigint").alias("seq"), is_heading.alias("is_heading"),
        F.when(is_heading, F.regexp_extract("line", heading, 1)).otherwise(F.col("line")).alias("text"),
    )


def heading_runs(blocks: DataFrame, akin: bool = False) -> DataFrame:
    """(DOC, run, owner_seq, owner_kind, heading, fld, items, at_end, before): the texts under one heading in one run, as one row.

    A run is a few thousand blocks of a document, so a very long document is spread over many tasks. `owner_seq` is the last
    rule or preamble heading before the texts inside their run, null before the first; `items` are the texts with the field
    they belong to, `fld` is the last field heading up to there, `at_end` marks a run's last heading and `before` counts the rules of the
    run before this one. Texts are sent out once, and every heading is judged once, before that. With `akin`, a column says
    whether a heading starts or continues another of its run, or stands in its preamble (see `akin_texts`).
    """
    heading = F.coalesce("is_heading", F.lit(True))
    row = blocks.select(*DOC, "seq", heading.alias("is_heading"), T.strip(F.col("text")).alias("text"))
    row = row.withColumn("key", F.when(F.col("is_heading"), F.rtrim(F.lower("text"), F.lit(":"))))
    row = row.withColumn("slot", literal_map(vocab.FIELD_HEADINGS)[F.col("key")])
    row = row.withColumn("kind", F.when(~F.col("is_heading"), "text").when(F.col("key").isin(vocab.PREAMBLE_HEADINGS), "preamble").when(
        F.col("slot").isNotNull(), "field").otherwise("rule"))
    marked = row.select(
        *DOC, F.greatest(F.floor(F.col("seq") / _CHUNK), F.lit(0)).alias("run"), "seq", "kind", F.when(F.col("kind") != "field", F.col("text")).alias("text"),
        F.when(F.col("kind") == "field", F.struct("seq", "slot")).alias("fld"))
    own = F.col("kind").isin("rule", "preamble")
    inside = Window.partitionBy(*DOC, "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.select(
        *DOC, "run", "seq", "kind", "text", F.max(F.when(own, F.col("seq"))).over(inside).alias("owner_seq"), F.last("fld", ignorenulls=True).over(inside).alias("fld"))
    in_field = F.col("fld.seq") > F.coalesce(F.col("owner_seq"), F.lit(-1))
    item = F.struct("seq", F.when(in_field, F.col("fld.seq")).alias("slot_seq"), F.when(in_field, F.col("fld.slot")).alias("slot"), "text")
    groups = placed.groupBy(*DOC, "run", "owner_seq").agg(
        F.first(F.when(own, F.col("kind")), ignorenulls=True).alias("owner_kind"), F.first(F.when(own, F.col("text")), ignorenulls=True).alias("heading"), F.max("fld").alias("fld"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "text", item))).alias("items"))
    order = Window.partitionBy(*DOC, "run").orderBy("owner_seq")
    more = [_akin().alias("akin")] if akin else []
    return cut(groups.withColumn("is_rule", _is_rule()).select(
        *more, *DOC, "run", "owner_seq", "owner_kind", "heading", "fld", "items", (F.row_number().over(order) == F.count("*").over(order.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))).alias("at_end"),
        (F.count_if("is_rule").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("is_rule").cast("int")).alias("before")))


def _short_name(name: Column) -> Column:
    return T.strip(F.substring_index(F.lower(name), " / ", 1))


def _akin() -> Column:
    """Whether the heading starts or continues another of its run, or stands in the run's preamble."""
    run = Window.partitionBy(*DOC, "run")
    low = F.when(F.col("owner_kind") == "rule", F.lower("heading"))
    names = F.collect_set(low).over(run)
    front = F.collect_list(F.when(F.col("owner_kind") == "preamble", F.transform("items", lambda i: i["text"]))).over(run)
    kin = F.exists(names, lambda n: F.startswith(low, F.concat(n, F.lit(" "))) | F.startswith(n, F.concat(low, F.lit(" "))))
    return F.coalesce(kin | F.contains(F.lower(F.array_join(F.flatten(front), "\n")), _short_name(F.col("heading"))), F.lit(True))


def _is_rule() -> Column:
    """A heading with a text in a field; one without any field is a section."""
    return F.coalesce((F.col("owner_kind") == "rule") & F.exists("items", lambda i: (i["text"] != "") & i["slot"].isNotNull()), F.lit(False))


def _owned(runs: DataFrame) -> DataFrame:
    """The texts before a run's first heading get the heading and the field that earlier runs ended with."""
    last = runs.where("at_end").select(
        *DOC, "run", F.when(F.col("owner_seq").isNotNull(), F.struct("owner_seq", "owner_kind", "heading")).alias("own"), "fld")
    before = Window.partitionBy(*DOC).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*DOC, "run", F.last("own", ignorenulls=True).over(before).alias("c_own"), F.last("fld", ignorenulls=True).over(before).alias("c_fld"))
    # Nothing comes before the first run, so short documents are not sent out again.
    open_ = "run > 0 and owner_seq is null"
    in_field = F.col("c_fld.seq") > F.coalesce(F.col("c_own.owner_seq"), F.lit(-1))
    items = F.transform("items", lambda i: F.when(i["slot_seq"].isNotNull() | F.coalesce(~in_field, F.lit(True)), i).otherwise(F.struct(
        i["seq"].alias("seq"), F.col("c_fld.seq").alias("slot_seq"), F.col("c_fld.slot").alias("slot"), i["text"].alias("text"))))
    kept = [*DOC, "run", "at_end", "before", *(c for c in ("akin",) if c in runs.columns)]
    later = runs.where(open_).join(carried, [*DOC, "run"]).select(*kept, "c_own.owner_seq", "c_own.owner_kind", "c_own.heading", items.alias("items"))
    return runs.where(f"not ({open_})").select(*kept, "owner_seq", "owner_kind", "heading", "items").unionByName(later)


def fill_of_runs(runs: DataFrame) -> DataFrame:
    """Each text with the heading that owns it and the field it belongs to."""
    return _owned(runs).select(*DOC, "owner_seq", "owner_kind", "heading", F.inline("items")).select(
        *DOC, "seq", "owner_seq", "owner_kind", "heading", F.when(F.col("owner_kind") == "rule", F.col("slot")).alias("slot"), "slot_seq", "text")


def heading_fill(blocks: DataFrame) -> DataFrame:
    """Each block with the heading that owns it and the field it belongs to.

    The last heading before a block is found in two steps: inside runs of a few thousand blocks, then
    across runs, so a very long document is spread over many tasks.
    """
    return fill_of_runs(heading_runs(blocks))


def rules_of_runs(runs: DataFrame) -> DataFrame:
    """The rules that `parse_rules` finds in the same blocks.

    Only the last heading of a document's first run, and later runs, can have texts in several rows; these are put together and
    numbered after the others, which are whole and numbered already, so their texts are not sent out again.
    """
    whole, rest = _whole_rules(runs)
    return _fields(whole.unionByName(rest))


def _whole_rules(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules that are whole in a document's first run, and the others; each with its texts."""
    owned = _owned(runs)
    more = [c for c in ("akin",) if c in runs.columns]
    whole = owned.where("run = 0 and not at_end").where(_is_rule()).select(*DOC, (F.col("before") + 1).cast("int").alias("position"), F.col("heading").alias("name"), "items", *more)
    joined = owned.where("run > 0 or at_end").groupBy(*DOC, "owner_seq").agg(
        F.first("owner_kind").alias("owner_kind"), F.first("heading").alias("name"), F.sort_array(F.flatten(F.collect_list("items"))).alias("items"),
        F.max(F.when(F.col("run") == 0, F.col("before"))).alias("before"), *(F.lit(True).alias(c) for c in more)).withColumn("is_rule", _is_rule())
    document = Window.partitionBy(*DOC)
    number = F.count_if("is_rule").over(document.orderBy("owner_seq").rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.max("before").over(document), F.lit(0))
    rest = joined.withColumn("position", number.cast("int")).where("is_rule").select(*DOC, "position", "name", "items", *more)
    told = F.filter("items", lambda i: i["text"] != "")
    return whole.withColumn("items", told), rest.withColumn("items", told)


def akin_texts(runs: DataFrame) -> DataFrame:
    """(DOC, position, standard, acceptable) of all rules that another rule or the preamble may be compared with, and of some more.

    Which these are was seen where a run was put in order (`heading_runs` with `akin`), so texts that nothing is compared with
    are not sent out. Of documents of several runs, and of a run's last heading, all are taken.
    """
    whole, rest = _whole_rules(runs)
    several = cut(runs.where("run > 0").select(*DOC).distinct())
    others = whole.where("not akin").join(several, DOC, "left_semi")
    return _fields(whole.where("akin").unionByName(others).unionByName(rest)).select(*DOC, "position", "standard", "acceptable")


def parse_rules(filled: DataFrame) -> DataFrame:
    """One row per rule. A heading without any field is a section and is left out here."""
    body = filled.where("owner_kind = 'rule' and text <> ''")
    item = F.struct("seq", "slot_seq", "slot", "text")
    rules = body.groupBy(*DOC, "owner_seq").agg(F.first("heading").alias("name"), F.sort_array(F.collect_list(item)).alias("items"))
    w = Window.partitionBy(*DOC).orderBy("owner_seq")
    found = rules.where(F.exists("items", lambda i: i["slot"].isNotNull())).withColumn("position", F.row_number().over(w))
    return _fields(found)


def _fields(rules: DataFrame) -> DataFrame:
    """The fields of each rule, from its items (seq, slot_seq, slot, text) in order."""

    def texts(slot: str) -> Column:
        return F.transform(F.filter("items", lambda i: i["slot"] == slot), lambda i: i["text"])

    def last_part(*slots: str) -> Column:
        """The items of the last non-empty occurrence of a field, which replaces earlier ones."""
        mine = F.filter("items", lambda i: i["slot"].isin(*slots))
        return T.let(mine, lambda m: F.filter(m, lambda i: i["slot_seq"] == F.element_at(m, -1)["slot_seq"]))

    def joined(slot: str) -> Column:
        return F.array_join(F.transform(last_part(slot), lambda i: i["text"]), "\n")

    flag = F.get(last_part("required", "optional"), F.lit(0))
    yes = F.startswith(F.lower(flag["text"]), F.lit("y"))
    required = F.when(flag["slot"] == "required", yes).when(flag["slot"] == "optional", ~yes)
    wide = rules.select(
        *DOC, "position", "name", joined("standard").alias("standard"), texts("acceptable").alias("acceptable"),
        texts("unacceptable").alias("unacceptable"), joined("guidance").alias("guidance"), texts("workflow").alias("workflow"),
        required.alias("required"))
    return wide.withColumn("g", T.guidance_fields(F.col("guidance"))).select(
        *DOC, "position", "name", "standard", "acceptable", "unacceptable", "guidance", "workflow", "required",
        "g.rule_id", "g.depends_on", "g.precedence", "g.on_exhaustion", "g.source", "g.reviewed",
    )


def _rule(df: DataFrame, code: Column | str, when: Column, evidence: Column | None = None) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    evidence = F.lit("") if evidence is None else evidence
    return df.where(when).select(*DOC, "position", F.col("name").alias("rule"), code.alias("code"), evidence.alias("evidence"))


def rule_id_missing(rules: DataFrame) -> DataFrame:
    return _rule(rules, "RULE_ID_MISSING", F.col("rule_id").isNull())


def duplicate_rule_ids(rules: DataFrame) -> DataFrame:
    w = Window.partitionBy(*DOC, "rule_id").orderBy("position")
    row = rules.where("rule_id is not null").withColumn("other", F.lag("name").over(w))
    return row.where("other is not null").select(*DOC, "rule_id", "name", "other")


def absence_missing(rules: DataFrame) -> DataFrame:
    return _rule(rules, "ABSENCE_REMEDIATION_MISSING", F.col("required") & ~T.absence_answered(F.col("standard")))


def deviation_missing(rules: DataFrame) -> DataFrame:
    codes = F.array_compact(F.array(
        F.when(F.size("acceptable") == 0, F.lit("NO_ACCEPTABLE_DEVIATION")),
        F.when(F.size("unacceptable") == 0, F.lit("UNACCEPTABLE_NOT_STATED"))))
    return rules.select(*DOC, "position", F.col("name").alias("rule"), F.explode(codes).alias("code")).withColumn("evidence", F.lit(""))


def deviation_unspecified(rules: DataFrame) -> DataFrame:
    row = rules.select(*DOC, "position", "name", F.explode("acceptable").alias("entry"))
    return _rule(row, "DEVIATION_UNSPECIFIED", T.matches(T.split_label(F.col("entry"))["body"], vocab.ONLY_REASONABLE), F.col("entry"))


def prose_gate(rules: DataFrame) -> DataFrame:
    phrase = F.nullif(F.regexp_extract("guidance", T.pattern(vocab.PROSE_GATE, "i"), 1), F.lit(""))
    row = rules.withColumn("phrase", phrase)
    return _rule(row, "PROSE_SUBSTITUTES_FOR_STRUCTURE", F.col("phrase").isNotNull(), F.col("phrase"))


def depends_unresolved(rules: DataFrame) -> DataFrame:
    refs = rules.select(*DOC, "position", "name", F.inline("depends_on"))
    ids = rules.where("rule_id is not null").select(*DOC, F.col("rule_id").alias("ref")).distinct().withColumn("known", F.lit(True))
    row = refs.join(ids, [*DOC, "ref"], "left")
    return _rule(row, "DEPENDS_ON_UNRESOLVED", F.col("known").isNull(), F.col("ref")).unionByName(
        _rule(row, "DEPENDENCY_REASON_MISSING", F.col("reason").isNull(), F.col("ref")))


def ladder_gap(rules: DataFrame) -> DataFrame:
    """A finite ceiling accepted, and only an unbounded floor refused."""
    acc, una = F.array_join("acceptable", " "), F.array_join("unacceptable", " ")
    ceiling = F.regexp_extract(acc, T.pattern(vocab.BOUNDED_TERM, "i"), 0)
    floor = F.regexp_extract(una, T.pattern(vocab.UNBOUNDED_TERM, "i"), 0)
    gap = (ceiling != "") & (floor != "") & ~T.matches(una, vocab.BOUNDED_TERM)
    return _rule(rules, "LADDER_GAP", gap, F.concat_ws(" / ", T.strip(ceiling), floor))


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(DOC, position, name_key) where a text contains a name, both lower-cased, per document.

    `texts`: DOC, position, low, one row per DOC and position. `names`: DOC, name_key. A text offers each of its substrings
    of a few characters as a join key, of the lengths that names of its document start with, and a name is looked up by its
    own first characters; so they meet on an equality, with ids alone, and only what meets is read again to be compared.
    """
    start = F.least(F.length("name_key"), F.lit(_GRAM))
    known = names.where(F.length("name_key") > 0).select(*DOC, "name_key", start.alias("size"), F.substring(F.col("name_key"), F.lit(1), start).alias("gram"))
    sizes = known.select(*DOC, "size").distinct()
    places = F.sequence(F.lit(1), F.length("low") - F.col("size") + 1)
    grams = F.array_distinct(F.transform(places, lambda i: F.substring(F.col("low"), i, F.col("size"))))
    offered = texts.join(sizes, DOC).where(F.length("low") >= F.col("size")).select(*DOC, "position", F.explode(grams).alias("gram"))
    met = offered.join(known.drop("size"), [*DOC, "gram"]).select(*DOC, "position", "name_key").distinct()
    return met.join(texts.select(*DOC, "position", "low"), [*DOC, "position"]).where(F.contains("low", "name_key")).select(*DOC, "position", "name_key")


def rule_name_mentions(rules: DataFrame) -> DataFrame:
    """(DOC, rule_a, rule_b): the precedence text of rule a contains the name of rule b."""
    texts = rules.where("precedence is not null").select(*DOC, "position", F.lower("precedence").alias("low"))
    names = rules.select(*DOC, F.lower("name").alias("name_key")).distinct()
    hit = mentions(texts, names)
    a = rules.select(*DOC, "position", F.col("name").alias("rule_a"))
    b = rules.select(*DOC, F.col("position").alias("position_b"), F.col("name").alias("rule_b"), F.lower("name").alias("name_key"))
    return hit.join(a, [*DOC, "position"]).join(b, [*DOC, "name_key"]).where("position <> position_b").select(
        *DOC, "position", "position_b", "rule_a", "rule_b")


def precedence_one_sided(rules: DataFrame) -> DataFrame:
    said = cut(rule_name_mentions(rules))
    back = said.select(*DOC, F.col("position").alias("position_b"), F.col("position_b").alias("position"))
    return said.join(back, [*DOC, "position", "position_b"], "left_anti").select(*DOC, "position", F.col("rule_a").alias("rule"), F.lit("PRECEDENCE_ONE_SIDED").alias("code"), F.col("rule_b").alias("evidence"))


def rule_name_prefix_pairs(rules: DataFrame) -> DataFrame:
    """(DOC, rule_a, rule_b): the name of b starts with the name of a and a blank.

    Each name offers its own starts that end before a blank, so parent and child meet on an equality.
    """
    low = F.lower("name")
    ends = F.filter(F.sequence(F.lit(1), F.length(low)), lambda i: F.substring(low, i + 1, F.lit(1)) == " ")
    child = rules.select(*DOC, F.col("position").alias("position_b"), F.col("name").alias("rule_b"), F.explode(F.transform(ends, lambda i: F.substring(low, F.lit(1), i))).alias("key"))
    parent = rules.select(*DOC, "position", F.col("name").alias("rule_a"), low.alias("key"))
    return child.join(parent, [*DOC, "key"]).where("position <> position_b").select(*DOC, "position", "position_b", "rule_a", "rule_b")


def parent_child_duplication(rules: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """`texts`: DOC, position, standard, acceptable of the rules that are in pairs, or of more (`akin_texts`); else those of `rules`."""
    texts = rules if texts is None else texts
    pairs = rule_name_prefix_pairs(rules)
    blob = F.array_join(F.concat("acceptable", F.array("standard")), " ")
    up = texts.select(*DOC, "position", T.content_tokens(blob).alias("up"))
    down = texts.where("standard <> ''").select(*DOC, F.col("position").alias("position_b"), T.content_tokens(F.col("standard")).alias("down"))
    row = pairs.join(up, [*DOC, "position"]).join(down, [*DOC, "position_b"]).withColumn("overlap", T.token_containment(F.col("down"), F.col("up")))
    return row.where(F.col("overlap") >= vocab.CHILD_CONTAINMENT).select(
        *DOC, F.col("position_b").alias("position"), F.col("rule_b").alias("rule"), F.col("rule_a").alias("parent"), F.round("overlap", 2).alias("overlap"))


def preambles(filled: DataFrame) -> DataFrame:
    lines = F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda r: r["text"])
    return filled.where("owner_kind = 'preamble' and text <> ''").groupBy(*DOC).agg(F.array_join(lines, "\n").alias("preamble"))


def preamble_restates(rules: DataFrame, filled: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Rules whose position the preamble repeats near the first mention of their name. `texts` as in `parent_child_duplication`."""
    names = rules if texts is None else rules.select(*DOC, "position", "name")
    row = names.join(preambles(filled), DOC).withColumns({"low": F.lower("preamble"), "short": _short_name(F.col("name"))})
    row = row.where((F.length("short") >= vocab.PREAMBLE_NAME_MIN) & F.contains("low", "short"))
    row = row if texts is None else row.join(texts, [*DOC, "position"])
    at = F.expr("locate(short, low)")
    window = F.substring(F.col("low"), at, F.lit(vocab.PREAMBLE_WINDOW))
    body = F.array_join(F.concat(F.array("standard"), "acceptable"), " ")
    overlap = T.token_containment(T.content_tokens(window), T.content_tokens(body))
    return _rule(row, "PREAMBLE_RESTATES_RULE", overlap >= vocab.PREAMBLE_CONTAINMENT, F.col("short"))


def document_level(rules: DataFrame, filled: DataFrame) -> DataFrame:
    """Document control, exhaustion default and rule count, from per-block tests folded per document."""
    front = filled.where("text <> ''").where(
        (F.col("owner_kind") == "preamble") | ((F.col("owner_kind") == "rule") & F.col("slot").isNull()))
    in_rule = filled.where("owner_kind = 'rule' and slot is not null and text <> ''").select(*DOC, "owner_seq").distinct()
    outside = front.join(in_rule, [*DOC, "owner_seq"], "left_anti")
    seen = outside.groupBy(*DOC).agg(
        F.bool_or(T.matches(F.col("text"), vocab.DOCUMENT_CONTROL)).alias("control"),
        F.bool_or(T.matches(F.col("text"), "exhaustion")).alias("default_path"))
    per = rules.groupBy(*DOC).agg(F.count("*").alias("rules"), F.bool_or(F.col("on_exhaustion").isNotNull()).alias("rule_path"))
    row = per.join(seen, DOC, "left").fillna(False, ["control", "default_path"])
    codes = F.array_compact(F.array(
        F.when(~F.col("control"), F.lit("DOCUMENT_CONTROL_MISSING")),
        F.when(~F.col("default_path") & ~F.col("rule_path"), F.lit("EXHAUSTION_DEFAULT_MISSING")),
        F.when(F.col("rules") > vocab.RULE_COUNT_LIMIT, F.lit("RULE_COUNT_HIGH"))))
    return row.select(*DOC, "rules", F.explode(codes).alias("code"))


def rule_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy(*DOC).agg(
        F.count("*").alias("rules"), F.count_if(F.size("acceptable") > 0).alias("with_acceptable"),
        F.count_if(F.size("unacceptable") > 0).alias("with_unacceptable"), F.count_if(F.col("rule_id").isNotNull()).alias("with_rule_id"),
        F.count_if(F.size("depends_on") > 0).alias("with_dependencies"), F.count_if(F.size("workflow") > 0).alias("with_workflow"),
        F.count_if(F.coalesce("required", F.lit(False))).alias("required"))


def document_findings(rules: DataFrame, filled: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Every check of the document audit in one table. `texts` as in `parent_child_duplication`."""
    dup = duplicate_rule_ids(rules).select(*DOC, F.lit(0).alias("position"), F.col("name").alias("rule"), F.lit("RULE_ID_DUPLICATE").alias("code"), F.col("other").alias("evidence"))
    kids = parent_child_duplication(rules, texts).select(*DOC, "position", "rule", F.lit("PARENT_CHILD_DUPLICATION").alias("code"), F.col("parent").alias("evidence"))
    whole = document_level(rules, filled).select(*DOC, F.lit(0).alias("position"), F.lit("").alias("rule"), "code", F.lit("").alias("evidence"))
    parts = [
        dup, rule_id_missing(rules), absence_missing(rules), deviation_missing(rules), deviation_unspecified(rules), prose_gate(rules),
        depends_unresolved(rules), ladder_gap(rules), precedence_one_sided(rules), kids, preamble_restates(rules, filled, texts), whole,
    ]
    return reduce(DataFrame.unionByName, parts)


def remedy_lookup(findings: DataFrame) -> DataFrame:
    return findings.withColumn("remedy", literal_map(vocab.REMEDIES)[F.col("code")])


# --- comparison of two editions ------------------------------------------------------


def _body(df: DataFrame) -> Column:
    return F.array_join(F.concat(F.array("standard"), "acceptable", "unacceptable"), " ")


def pair_rules(before: DataFrame, after: DataFrame) -> DataFrame:
    """(playbook_id, before, after, matched_by, score): rules of two editions matched one to one.

    First by identity, then by folded name, then by content. Content matching takes rules in their
    order, each its best remaining partner. Rounds settle, all documents together, every rule whose
    choice no earlier rule could still claim; the result is that of going one by one.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("playbook_id", F.col("position").alias(name), "rule_id", T.norm_rule_name(F.col("name")).alias("name_key"))

    def texts(df: DataFrame, rest: DataFrame, name: str) -> DataFrame:
        row = df.withColumnRenamed("position", name).join(cut(rest.select("playbook_id", name)), ["playbook_id", name])
        return row.select("playbook_id", F.concat(F.lit(name[0]), name).alias("id"), _body(df).alias("body"))

    b, a = cut(side(before, "before")), cut(side(after, "after"))

    def match(b: DataFrame, a: DataFrame, key: str, how: str) -> DataFrame:
        first = b.where(F.col(key).isNotNull()).groupBy("playbook_id", key).agg(F.min("before").alias("before"))
        last = a.where(F.col(key).isNotNull()).groupBy("playbook_id", key).agg(F.max("after").alias("after"))
        return first.join(last, ["playbook_id", key]).select("playbook_id", "before", "after", F.lit(how).alias("matched_by"), F.lit(1.0).alias("score"))

    by_id = cut(match(b, a, "rule_id", "rule_id"))
    b1 = b.join(by_id, ["playbook_id", "before"], "left_anti")
    a1 = a.join(by_id, ["playbook_id", "after"], "left_anti")
    by_name = cut(match(b1, a1, "name_key", "name"))
    b2 = texts(before, b1.join(by_name, ["playbook_id", "before"], "left_anti"), "before")
    a2 = texts(after, a1.join(by_name, ["playbook_id", "after"], "left_anti"), "after")
    # Written first, or all rules would be taken apart into tokens before that join, for the sake of the filter.
    rest = cut(b2.unionByName(a2))
    both = cut(rest.select("playbook_id", "id", T.content_tokens(F.col("body")).alias("tokens")).where(F.size("tokens") > 0))
    links = similar_sets(both, ["playbook_id"], vocab.RENAME_SIMILARITY).where("a like 'a%' and b like 'b%'")
    left = cut(links.select(
        "playbook_id", F.expr("cast(substring(b, 2) as int)").alias("before"), F.expr("cast(substring(a, 2) as int)").alias("after"), "score"))
    settled: list[DataFrame] = [by_id, by_name]
    while not left.isEmpty():
        best = left.groupBy("playbook_id", "before").agg(F.max_by(F.struct("after", "score"), F.struct("score", -F.col("after"))).alias("p"))
        earliest = left.groupBy("playbook_id", "after").agg(F.min("before").alias("earliest"))
        sure = cut(
            best.select("playbook_id", "before", "p.after", "p.score").join(earliest, ["playbook_id", "after"]).where("before = earliest")
            .select("playbook_id", "before", "after", F.lit("content").alias("matched_by"), "score"))
        settled.append(sure)
        left = cut(left.join(sure, ["playbook_id", "before"], "left_anti").join(sure, ["playbook_id", "after"], "left_anti"))
    return reduce(DataFrame.unionByName, settled)


def _sides(pairs: DataFrame, before: DataFrame, after: DataFrame, *more: Column) -> DataFrame:
    fields = ["name", "rule_id", T.norm_rule_name(F.col("name")).alias("key"), *more]
    b = before.select("playbook_id", F.col("position").alias("before"), F.struct(*fields).alias("b"))
    a = after.select("playbook_id", F.col("position").alias("after"), F.struct(*fields).alias("a"))
    return b.join(pairs, ["playbook_id", "before"], "left").join(a, ["playbook_id", "after"], "full")


def diff_counts(pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    # Digests meet instead of the texts, which are only compared for being the same.
    row = _sides(pairs, before, after, F.col("required"), F.sha2(_body(before), 256).alias("body"), F.sha2("guidance", 256).alias("guidance"))
    c = F.col
    matched = c("a").isNotNull() & c("b").isNotNull()
    exact = matched & (c("matched_by") != "content")
    renamed = matched & ((c("matched_by") == "content") | (c("b.key") != c("a.key")))
    changed = exact & ((c("b.body") != c("a.body")) | (c("b.guidance") != c("a.guidance")) | ~c("b.required").eqNullSafe(c("a.required")))
    return row.groupBy("playbook_id").agg(
        F.count_if(c("b").isNull()).alias("added"), F.count_if(c("a").isNull()).alias("removed"), F.count_if(renamed).alias("renamed"),
        F.count_if(changed).alias("changed"), F.count_if(exact & ~changed).alias("unchanged"))


def rename_findings(pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    row = _sides(pairs, before, after).where("a is not null and b is not null")
    c = F.col
    by_content = c("matched_by") == "content"
    renamed = F.when(by_content | (c("b.key") != c("a.key")), F.lit("RULE_RENAMED"))
    moved = F.when(~by_content & (c("b.rule_id") != c("a.rule_id")), F.lit("RULE_ID_CHANGED"))
    out = row.select("playbook_id", F.explode(F.array_compact(F.array(renamed, moved))).alias("code"), c("b.name").alias("from_name"), c("a.name").alias("to_name"),
                     c("b.rule_id").alias("from_id"), c("a.rule_id").alias("to_id"), F.when(by_content, "content").otherwise("rule_id").alias("by"), F.round("score", 2).alias("score"))
    return out


def reference_broken(after: DataFrame) -> DataFrame:
    refs = after.select("playbook_id", "position", "name", F.inline("depends_on"))
    ids = after.where("rule_id is not null").select("playbook_id", F.col("rule_id").alias("ref"))
    return refs.join(ids, ["playbook_id", "ref"], "left_anti").select("playbook_id", "position", "name", F.col("ref").alias("target"))


def names_gone(before: DataFrame, after: DataFrame) -> DataFrame:
    """Folded names of the first edition that the second no longer has."""
    old = before.select("playbook_id", T.norm_rule_name(F.col("name")).alias("name_key")).distinct()
    new = after.select("playbook_id", T.norm_rule_name(F.col("name")).alias("name_key"))
    return old.join(new, ["playbook_id", "name_key"], "left_anti")


def former_name_mentions(pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Rules of the second edition that still use a name which is gone, their own or another's."""
    edition = after.select("playbook_id", "edition").distinct()
    gone = names_gone(before, after).join(edition, "playbook_id")
    texts = after.select(*DOC, "position", F.lower(F.concat_ws(" ", "precedence", "guidance")).alias("low"))
    hit = mentions(texts, gone).drop("edition")
    row = _sides(pairs, before, after).where("a is not null and b is not null")
    renamed = row.where((F.col("matched_by") == "content") | (F.col("b.key") != F.col("a.key")))
    own = renamed.select("playbook_id", F.col("after").alias("position"), F.col("b.key").alias("name_key"), F.lit(True).alias("own"))
    now = renamed.groupBy("playbook_id", F.col("b.key").alias("name_key")).agg(F.max_by("a.name", "after").alias("now"))
    names = after.select("playbook_id", "position", "name")
    return hit.join(own, ["playbook_id", "position", "name_key"], "left").join(now, ["playbook_id", "name_key"], "left").join(names, ["playbook_id", "position"]).select(
        "playbook_id", "position", "name", F.col("name_key").alias("former_name"), "now",
        F.when(F.col("own"), "RENAMED_RULE_SELF_REFERENCE").otherwise("REFERENCE_TO_RENAMED_RULE").alias("code"))


def rule_removed(pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Rules that are gone, with how many rules of the second edition still name them."""
    gone = before.join(pairs.withColumnRenamed("before", "position"), ["playbook_id", "position"], "left_anti").select(
        "playbook_id", "position", "name", "rule_id", T.norm_rule_name(F.col("name")).alias("name_key"))
    edition = after.select("playbook_id", "edition").distinct()
    texts = after.where("precedence is not null").select(*DOC, "position", T.norm_rule_name(F.col("precedence")).alias("low"))
    hit = mentions(texts, gone.select("playbook_id", "name_key").distinct().join(edition, "playbook_id")).groupBy("playbook_id", "name_key").agg(F.count("*").alias("referenced_by"))
    return gone.join(hit, ["playbook_id", "name_key"], "left").fillna(0, ["referenced_by"]).select("playbook_id", "position", "name", "rule_id", "referenced_by")
