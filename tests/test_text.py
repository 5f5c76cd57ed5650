from pyspark.sql import functions as F

from specaudit.functions import text as T
from specaudit.functions.normalise import failure_class_of, slug
from specaudit.operators import lint as L
from specaudit.operators.references import find_refs, referenced_names


def one(spark, value, use):
    return spark.createDataFrame([(value,)], "t string").select(use(F.col("t")).alias("v")).first().v


def test_entity_forms(spark):
    def forms(text, name="Cedar Point Storage, LLC"):
        return one(spark, text, lambda c: T.entity_forms(c, F.lit(name)))

    assert forms("signed by Cedar Point Storage LLC and Cedar Point Storage, L.L.C. today") == [
        "Cedar Point Storage LLC", "Cedar Point Storage, L.L.C."]
    assert forms("signed by Cedar Point Storage, LLC today") == []
    assert forms("only Cedar Point Storage signed") == ["Cedar Point Storage"]
    assert forms("see Birchworks now", "Birch, Inc.") == ["Birch"]


def test_sections_keep_last_body(spark):
    got = one(spark, "intro\n# A\none\n## B\ntwo\n# A\nthree", T.sections)
    assert [(s.name, s.body.strip()) for s in got] == [("", "intro"), ("b", "two"), ("a", "three")]


def test_positive_lines_skip_prohibitions(spark):
    text = "Return `N/A` when blank.\nDo not return `N/A`.\nN/A is a word here."
    assert one(spark, text, lambda c: T.positive_term_lines(c, "N/A")) == ["Return `N/A` when blank."]


def test_currency_style(spark):
    for sample, style in {"$1,250.00": "$9,999.99", "1250 EUR": "9999 EUR", "USD 7": "USD 9", "$12.5": "$9999.99"}.items():
        assert one(spark, sample, T.currency_style) == style


def test_split_label(spark):
    assert tuple(one(spark, "Short term\nUp to three years.", T.split_label)) == ("Short term", "Up to three years.")
    assert tuple(one(spark, "Short termUp to three years.", T.split_label)) == ("Short term", "Up to three years.")
    assert tuple(one(spark, "plain words only", T.split_label)) == (None, "plain words only")


def test_guidance_fields(spark):
    g = one(spark, "Rule ID: term.cap.\nDepends on: a.b (ordering) and c.d\nPrecedence: over Caps.\nSource: Manual · Reviewed: 2024-01-01", T.guidance_fields)
    assert g.rule_id == "term.cap"
    assert [tuple(d) for d in g.depends_on] == [("a.b", "ordering"), ("c.d", None)]
    assert (g.precedence, g.source, g.reviewed, g.on_exhaustion) == ("over Caps.", "Manual", "2024-01-01", None)


def test_labels(spark):
    assert one(spark, " Holder/Direction error ", failure_class_of) == "holder_direction_error"
    assert one(spark, "Brand new", failure_class_of) == "brand_new"
    assert one(spark, "  ", failure_class_of) is None
    assert one(spark, " A b--C! ", slug) == "a-b-c"


NAMES = [(1, 1, "Date", 1), (1, 2, "Date Signed", 2), (1, 3, "Été", 3)]


def refs(spark, text):
    texts = spark.createDataFrame([(7, 1, text)], "text_id long, table_id long, text string")
    names = spark.createDataFrame(NAMES, "table_id long, column_id long, name string, position int")
    return find_refs(texts, names)


def test_longest_name_wins_and_ends_at_a_word(spark):
    got = referenced_names(refs(spark, "Use @date signed, @Dates and @Date. Mail x@y.com; see @Éte @été now @unknown thing is here")).first()
    assert got.resolved == ["Date Signed", "Date"]
    assert got.unresolved == ["Dates", "unknown thing"]


def test_offsets(spark):
    rows = refs(spark, "a @Date b @Nope, c").orderBy("start_at").collect()
    assert [(r.start_at, r.raw, r.resolved_id) for r in rows] == [(3, "Date", 1), (11, "Nope", None)]


def lint(spark, rule, text, native_type="FreeResponse", options=None, name="Other", position=1, **kw):
    row = spark.createDataFrame(
        [(7, 9, 1, name, position, native_type, options, text)],
        "text_id long, column_id long, table_id long, name string, position int, native_type string, options array<string>, text string")
    return [(r.code, r.evidence) for r in rule(row, **kw).collect()]


def test_lint_rules(spark):
    names = spark.createDataFrame(NAMES, "table_id long, column_id long, name string, position int")
    assert lint(spark, L.lint_length, "x" * 6000) == []
    assert lint(spark, L.lint_length, "x" * 6001) == [("PROMPT_LENGTH_ADVISORY", "6001")]
    assert lint(spark, L.lint_length, "x" * 10001) == [("PROMPT_LENGTH_HARD", "10001")]
    assert lint(spark, L.lint_not_stated, "Return `Not stated`.") == [("FALLBACK_NOT_STATED_UNTYPED", "Return `Not stated`.")]
    assert lint(spark, L.lint_not_stated, "Return `Not stated`.", "Date") == []
    assert lint(spark, L.lint_not_addressed, "Return `Not addressed`.", "Date") == [("FALLBACK_NOT_ADDRESSED_TYPED", "Return `Not addressed`.")]
    assert lint(spark, L.lint_label_not_configured, "Return `Yes`, `Maybe` or `Date`.", "Classify", ["Yes"], names=names) == [("CLASSIFY_LABEL_NOT_CONFIGURED", "Maybe")]
    assert lint(spark, L.lint_qualifier, "Unable to determine — reason", "Classify") == [("CLASSIFY_QUALIFIER_PERMITTED", "Unable to determine — r")]
    assert lint(spark, L.lint_options_missing, "x", "Classify") == [("OPTIONS_MISSING", "")]
    assert lint(spark, L.lint_options_missing, "x", "Classify", ["Yes"]) == []
    assert lint(spark, L.lint_output_contract, "Say something.") == [("OUTPUT_CONTRACT_MISSING", "")]
    assert lint(spark, L.lint_output_contract, "## Output\nplain") == []
    assert lint(spark, L.lint_markdown, "The answer may use bullets.") == [("MARKDOWN_IN_CELL", "The answer may use bullets.")]
    assert lint(spark, L.lint_markdown, "The answer may use bullets.\n## Output\nUse Markdown.") == []
    assert lint(spark, L.lint_character_rule, "Keep under 1,200 characters.\nNever count 10 characters.") == [("CHARACTER_COUNT_RULE", "Keep under 1,200 characters.")]
    text = "## Established results\n- In: @Date\n## Rules\nDecide."
    assert lint(spark, L.lint_dead_reference, text, refs=refs(spark, text)) == [("DEAD_REFERENCE", "Date")]
    used = text + " Compare with the date."
    assert lint(spark, L.lint_dead_reference, used, refs=refs(spark, used)) == []
    assert lint(spark, L.lint_ref_forward, "@Date Signed", refs=refs(spark, "@Date Signed"), names=names) == [("REF_FORWARD", "Date Signed")]
    assert lint(spark, L.lint_ref_self, "@Date", name="date", refs=refs(spark, "@Date")) == [("REF_SELF", "Date")]
