"""Rules over prompt texts.

Input rows are prompt versions in the context of their column: text_id, column_id, table_id, name,
position, native_type, options (array or null), text. Rules that need only the row are array
expressions, so a whole corpus is linted in one narrow scan. Rules about references or about the
names of other columns add equi-joins on the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specaudit import vocab
from specaudit.functions import text as T
from specaudit.functions.normalise import literal_array

_OUT = ["text_id", "column_id", "code", "evidence"]


def prompt_rows(versions: DataFrame, columns: DataFrame) -> DataFrame:
    c = columns.select("column_id", "table_id", "name", "position", "native_type", F.split("options", r"\|").alias("options"))
    return versions.select(F.col("prompt_version_id").alias("text_id"), "column_id", "text").join(c, "column_id")


def _none() -> Column:
    return F.array().cast("array<struct<code:string,evidence:string>>")


def _when(test: Column, code: Column | str, evidence: Column) -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    return F.when(test, F.array(F.struct(code.alias("code"), evidence.cast("string").alias("evidence")))).otherwise(_none())


def _lines(found: Column, code: str, label: Column | None = None) -> Column:
    """One finding with all offending lines, if there are any."""
    def entry(lines: Column) -> Column:
        text = F.array_join(lines, "|")
        return _when(F.size(lines) > 0, code, text if label is None else F.concat(label, F.lit(": "), text))

    return T.let(found, entry)


def _findings(df: DataFrame, *entries: Column) -> DataFrame:
    """(text_id, column_id, code, evidence) of all entries, worked out in one pass over the rows."""
    return df.select("text_id", "column_id", F.inline(F.flatten(F.array(*entries))))


def _length() -> Column:
    n = F.length("text")
    code = F.when(n > vocab.CHAR_LIMIT_HARD, "PROMPT_LENGTH_HARD").otherwise("PROMPT_LENGTH_ADVISORY")
    return _when(n > vocab.CHAR_LIMIT_ADVISORY, code, n)


def _synonym() -> Column:
    used = F.filter(literal_array(vocab.FALLBACK_SYNONYMS), lambda t: F.contains(F.lower("text"), F.lower(t)))
    return F.flatten(F.transform(used, lambda t: _lines(T.positive_term_lines(F.col("text"), t), "FALLBACK_SYNONYM", t)))


def _not_stated() -> Column:
    return F.when(~F.col("native_type").isin(vocab.TYPED_COLUMNS), _lines(T.positive_term_lines(F.col("text"), "Not stated"), "FALLBACK_NOT_STATED_UNTYPED")).otherwise(_none())


def _not_addressed() -> Column:
    return F.when(F.col("native_type").isin(vocab.TYPED_COLUMNS), _lines(T.positive_term_lines(F.col("text"), "Not addressed"), "FALLBACK_NOT_ADDRESSED_TYPED")).otherwise(_none())


def _qualifier() -> Column:
    dash = F.regexp_extract("text", T.pattern(vocab.EM_DASH_QUALIFIER, "i"), 0)
    phrase = F.regexp_extract("text", T.pattern(vocab.QUALIFIER_PHRASE, "i"), 0)
    match = F.coalesce(F.nullif(dash, F.lit("")), F.nullif(phrase, F.lit("")))
    return _when((F.col("native_type") == "Classify") & match.isNotNull(), "CLASSIFY_QUALIFIER_PERMITTED", match)


def _options_missing() -> Column:
    return _when((F.col("native_type") == "Classify") & (F.coalesce(F.size("options"), F.lit(0)) <= 0), "OPTIONS_MISSING", F.lit(""))


def _output_contract() -> Column:
    heading = T.matches(F.col("text"), vocab.OUTPUT_HEADING, "imd")
    says = T.matches(F.col("text"), vocab.RETURN_WORD)
    return _when(~heading & ~says, "OUTPUT_CONTRACT_MISSING", F.lit(""))


def _markdown() -> Column:
    def is_output(name: Column) -> Column:
        return T.matches(name, vocab.OUTPUT_SECTION)

    def permissive(secs: Column) -> Column:
        out = F.array_join(F.transform(F.filter(secs, lambda s: is_output(s["name"])), lambda s: s["body"]), "\n")
        allows = T.matches(out, vocab.MARKDOWN_ALLOW) & ~T.matches(out, vocab.PLAIN_TEXT)
        body = F.flatten(F.transform(F.filter(secs, lambda s: ~is_output(s["name"])), lambda s: T.lines(s["body"])))
        kept = F.filter(
            body,
            lambda ln: T.matches(ln, vocab.MARKDOWN_TERMS) & T.matches(ln, vocab.ANSWER_LINE)
            & ~T.matches(ln, vocab.NEGATED_LINE) & ~T.matches(ln, vocab.PLAIN_TEXT),
        )
        return F.when(~allows, F.transform(kept, T.strip))

    return F.when(T.matches(F.col("text"), vocab.MARKDOWN_TERMS), _lines(T.let(T.sections(F.col("text")), permissive), "MARKDOWN_IN_CELL")).otherwise(_none())


def _character_rule() -> Column:
    found = F.transform(
        F.filter(T.lines(F.col("text")), lambda ln: T.matches(ln, vocab.CHARACTER_COUNT) & ~T.matches(ln, vocab.NEGATED_LINE)), T.strip
    )
    return F.when(T.matches(F.col("text"), vocab.CHARACTER_COUNT), _lines(found, "CHARACTER_COUNT_RULE")).otherwise(_none())


def lint_length(df: DataFrame) -> DataFrame:
    return _findings(df, _length())


def lint_synonym(df: DataFrame) -> DataFrame:
    return _findings(df, _synonym())


def lint_not_stated(df: DataFrame) -> DataFrame:
    return _findings(df, _not_stated())


def lint_not_addressed(df: DataFrame) -> DataFrame:
    return _findings(df, _not_addressed())


def lint_qualifier(df: DataFrame) -> DataFrame:
    return _findings(df, _qualifier())


def lint_options_missing(df: DataFrame) -> DataFrame:
    return _findings(df, _options_missing())


def lint_output_contract(df: DataFrame) -> DataFrame:
    return _findings(df, _output_contract())


def lint_markdown(df: DataFrame) -> DataFrame:
    return _findings(df, _markdown())


def lint_character_rule(df: DataFrame) -> DataFrame:
    return _findings(df, _character_rule())


def lint_row_rules(df: DataFrame) -> DataFrame:
    """Every rule that needs only the row, in one narrow scan."""
    return _findings(df, _length(), _synonym(), _not_stated(), _not_addressed(), _qualifier(), _options_missing(), _output_contract(), _markdown(), _character_rule())


def lint_label_not_configured(df: DataFrame, names: DataFrame) -> DataFrame:
    """Labels a Classify prompt returns that are no option, no fallback state and no column name."""
    allowed = F.concat(
        F.transform(F.coalesce("options", F.array().cast("array<string>")), lambda o: F.lower(F.trim(o))),
        literal_array([v.lower() for v in vocab.FALLBACK_VOCABULARY]),
    )
    tokens = F.transform(T.output_tokens(F.col("text")), lambda t: F.regexp_replace(t, "^[“”\"']+|[“”\"']+$", ""))
    kept = F.filter(
        tokens,
        lambda t: (t != "") & ~F.contains(t, F.lit("@")) & ~F.array_contains(allowed, F.lower(t))
        & t.rlike(r"^\p{Lu}") & (F.length(t) <= vocab.LABEL_MAX_CHARS),
    )
    # first position of each distinct label, so evidence keeps the order of the text
    labels = df.where("native_type = 'Classify'").select("text_id", "column_id", "table_id", F.posexplode(F.array_distinct(kept)).alias("at", "label"))
    known = names.select("table_id", F.lower("name").alias("label_key")).distinct()
    unknown = labels.withColumn("label_key", F.lower("label")).join(known, ["table_id", "label_key"], "left_anti")
    rows = F.sort_array(F.collect_list(F.struct("at", "label")))
    text = F.array_join(F.transform(rows, lambda r: r["label"]), "|")
    return unknown.groupBy("text_id", "column_id").agg(text.alias("evidence")).withColumn("code", F.lit("CLASSIFY_LABEL_NOT_CONFIGURED")).select(*_OUT)


def _refs_with_context(df: DataFrame, refs: DataFrame) -> DataFrame:
    return refs.join(df.select("text_id", "column_id", F.lower("name").alias("own_name"), F.col("position").alias("own_position")), "text_id")


def lint_ref_self(df: DataFrame, refs: DataFrame) -> DataFrame:
    row = _refs_with_context(df, refs).where(F.lower("resolved_name") == F.col("own_name"))
    return row.select("text_id", "column_id", F.lit("REF_SELF").alias("code"), F.col("resolved_name").alias("evidence")).distinct()


def lint_ref_unresolved(df: DataFrame, refs: DataFrame) -> DataFrame:
    row = _refs_with_context(df, refs).where("resolved_id is null")
    return row.select("text_id", "column_id", F.lit("REF_UNRESOLVED").alias("code"), F.col("raw").alias("evidence")).distinct()


def lint_ref_forward(df: DataFrame, refs: DataFrame, names: DataFrame) -> DataFrame:
    """References to a column further along; where a name repeats, its last holder's position counts."""
    at = names.groupBy("table_id", F.lower("name").alias("name_key")).agg(
        F.max_by("position", "column_id").alias("up_position"))
    row = _refs_with_context(df, refs).where("resolved_id is not null").withColumn("name_key", F.lower("resolved_name"))
    hit = row.where(F.col("name_key") != F.col("own_name")).join(at, ["table_id", "name_key"]).where("up_position > own_position")
    return hit.select("text_id", "column_id", F.lit("REF_FORWARD").alias("code"), F.col("resolved_name").alias("evidence")).distinct()


def use_text(text: Column) -> Column:
    """The part of a prompt that can use a declared input: no established-results section, no declarations."""
    secs = F.filter(T.sections(text), lambda s: ~T.matches(s["name"], vocab.ESTABLISHED_HEADING))
    body = F.flatten(F.transform(secs, lambda s: F.concat(F.array(s["name"]), T.lines(s["body"]))))
    return F.array_join(F.filter(body, lambda ln: ~T.matches(ln, vocab.DECLARATION_LINE, "")), "\n")


def lint_dead_reference(df: DataFrame, refs: DataFrame) -> DataFrame:
    """Declared inputs that no rule mentions, unless a general phrase covers them all."""
    texts = df.where(F.contains("text", F.lit("@"))).select("text_id", use_text(F.col("text")).alias("used")).where(
        ~T.matches(F.col("used"), vocab.GENERIC_UPSTREAM_USE))
    declared = _refs_with_context(df, refs).where("resolved_id is not null").where(F.lower("resolved_name") != F.col("own_name"))
    pairs = declared.select("text_id", "column_id", "resolved_name").distinct().join(texts, "text_id")
    form = F.concat(F.lit(r"(?iU)(?<!\w)"), T.quote(F.col("resolved_name")), F.lit(r"(?!\w)"))
    dead = pairs.where(~F.rlike("used", form))
    return dead.select("text_id", "column_id", F.lit("DEAD_REFERENCE").alias("code"), F.col("resolved_name").alias("evidence"))


def lint_references(df: DataFrame, names: DataFrame, refs: DataFrame) -> DataFrame:
    """The rules about the order and the targets of references."""
    return reduce(DataFrame.unionByName, [lint_ref_self(df, refs), lint_ref_unresolved(df, refs), lint_ref_forward(df, refs, names)])


def lint_prompts(df: DataFrame, names: DataFrame, refs: DataFrame) -> DataFrame:
    """All rules over all rows, as one table of (text_id, column_id, code, evidence)."""
    parts = [lint_row_rules(df), lint_label_not_configured(df, names), lint_references(df, names, refs), lint_dead_reference(df, refs)]
    return reduce(DataFrame.unionByName, parts)


def text_rule_scan(texts: DataFrame, rules: list[tuple[str, str, str | None]]) -> DataFrame:
    """Any (rule id, include pattern, exclude pattern) list over any corpus: offending lines per rule.

    The rules become one expression each inside a single scan, whatever their number.
    """
    def hits(include: str, exclude: str | None) -> Column:
        def test(ln: Column) -> Column:
            keep = T.matches(ln, include)
            return keep if exclude is None else keep & ~T.matches(ln, exclude)

        return F.when(T.matches(F.col("text"), include, "im"), F.transform(F.filter(T.lines(F.col("text")), test), T.strip))

    found = F.array(*[F.struct(F.lit(rule).alias("rule_id"), hits(inc, exc).alias("lines")) for rule, inc, exc in rules])
    rows = texts.select("doc_id", F.inline(found)).where(F.size("lines") > 0)
    return rows.select("doc_id", "rule_id", "lines", F.size("lines").cast("bigint").alias("n_lines"))
