"""Text scanning as column expressions.

Everything here works inside one row on array functions, so a corpus scan never shuffles
its texts. Patterns run with Unicode classes so that letters outside ASCII count as letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specaudit import vocab
from specaudit.functions.normalise import literal_array, strip

LINE_BREAK = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"


def pattern(text: str, flags: str = "") -> str:
    return f"(?{flags}U){text}"


def matches(c: Column, text: str, flags: str = "i") -> Column:
    return c.rlike(pattern(text, flags))


def extract_all(c: Column, text: str, group: int = 0, flags: str = "i") -> Column:
    return F.regexp_extract_all(c, F.lit(pattern(text, flags)), F.lit(group))


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def let(value: Column, use) -> Column:
    """Bind an expression to a name inside a larger one, so it is evaluated once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def char_count(c: Column) -> Column:
    return F.length(c)


def output_tokens(c: Column) -> Column:
    """What a prompt presents as returnable: back-ticked tokens, then what follows "return"."""
    found = F.concat(
        extract_all(c, vocab.BACKTICK, 1, ""), extract_all(c, vocab.RETURN_PHRASE, 1)
    )
    return F.transform(found, strip)


def presented_tokens(line: Column) -> Column:
    return F.transform(output_tokens(line), F.lower)


def positive_term_lines(c: Column, term: str | Column) -> Column:
    """Lines that present the term as an output and are not prohibitions."""
    low = F.lit(term.lower()) if isinstance(term, str) else F.lower(term)
    kept = F.filter(
        lines(c),
        lambda ln: F.contains(F.lower(ln), low)
        & F.array_contains(presented_tokens(ln), low)
        & ~matches(ln, vocab.NEGATED_LINE),
    )
    return F.transform(kept, strip)


def fallback_terms_used(c: Column) -> Column:
    return F.filter(
        literal_array(vocab.FALLBACK_VOCABULARY),
        lambda term: F.size(positive_term_lines(c, term)) > 0,
    )


def vocabulary_missing(c: Column, terms: list[str]) -> Column:
    return F.filter(literal_array(terms), lambda t: ~F.contains(F.lower(c), F.lower(t)))


def sections(c: Column) -> Column:
    """Array of (name, body): the preamble under '', then headings; a repeated name keeps its last body."""
    names = F.transform(extract_all(c, vocab.HEADING_LINE, 1, "md"), lambda n: F.lower(strip(n)))
    bodies = F.split(c, pattern(vocab.HEADING_LINE, "md"), -1)
    pieces = F.arrays_zip(
        F.concat(F.array(F.lit("")), names).alias("name"), bodies.alias("body"), F.sequence(F.lit(1), F.size(bodies)).alias("at")
    )
    return let(pieces, lambda all_: F.filter(
        all_, lambda s: ~F.exists(all_, lambda later: (later["name"] == s["name"]) & (later["at"] > s["at"]))))


def date_pattern_tokens(c: Column) -> Column:
    longest_first = sorted(vocab.DATE_TOKENS, key=len, reverse=True)
    alternatives = "|".join(t.replace(".", r"\.") for t in longest_first)
    return F.array_distinct(F.regexp_extract_all(c, F.lit(alternatives), F.lit(0)))


def currency_samples(c: Column) -> Column:
    return F.array_distinct(extract_all(c, vocab.CURRENCY_PATTERN, 0, ""))


def currency_style(c: Column) -> Column:
    """A sample with its digits masked, so amounts of one format fall together."""
    masked = F.regexp_replace(c, r"(?U)\d", "9")
    grouped = F.regexp_replace(masked, "9[9,]*,[9,]*9", "#")
    plain = F.regexp_replace(grouped, "99+", "9999")
    return strip(F.replace(F.regexp_replace(plain, r"\.9+", ".99"), F.lit("#"), F.lit("9,999")))


def suffix_alternatives() -> str:
    longest_first = sorted(vocab.ENTITY_SUFFIXES, key=len, reverse=True)
    return "|".join(s.replace(".", r"\.") for s in longest_first)


def split_entity(c: Column) -> Column:
    """(base, suffix) of a printed entity name; the suffix is empty when none is recognised."""
    name = strip(c)
    form = pattern(rf"^(.*?)[,\s]+({suffix_alternatives()})\.?$")
    base = strip(F.regexp_extract(name, form, 1))
    return F.struct(
        F.when(base != "", base).otherwise(name).alias("base"),
        F.when(base != "", F.regexp_extract(name, form, 2)).otherwise("").alias("suffix"),
    )


def quote(c: Column) -> Column:
    """Make a value safe inside a pattern."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|#\-])", r"\\$1")


def entity_forms(text: Column, exact: Column) -> Column:
    """Printed forms of an entity's base name that differ from the exact name."""
    base = split_entity(exact)["base"]
    words = F.array_join(F.transform(F.split(base, r"(?U)\s+"), quote), r"\s+")
    form = F.concat(F.lit(r"(?iU)\b"), words, F.lit(rf"(?:\s*,?\s*(?:{suffix_alternatives()})\.?)?"))
    found = F.transform(
        F.regexp_extract_all(text, form, F.lit(0)),
        lambda f: F.trim(F.regexp_replace(f, r"(?U)\s+", " ")),
    )
    bare = F.regexp_replace(exact, r"\.+$", "")
    different = F.filter(
        found,
        lambda f: (f != exact)
        & ~((F.regexp_replace(f, r"\.+$", "") == bare) & (F.lower(f) == F.lower(exact))),
    )
    first_word = F.lower(F.get(F.split(base, r"(?U)\s+"), F.lit(0)))
    return F.when(
        (F.length(base) >= 4) & F.contains(F.lower(text), first_word), F.array_distinct(different)
    ).otherwise(F.array().cast("array<string>"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def name_tokens(c: Column) -> Column:
    return F.array_except(F.array_distinct(words(c)), literal_array(vocab.NAME_STOP_WORDS))


def content_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(words(c), lambda w: F.length(w) > 3))


def token_jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    total = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / total).otherwise(F.lit(0.0))


def token_containment(a: Column, b: Column) -> Column:
    """Share of the first set's tokens that the second holds."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def count_occurrences(text: Column, value: Column) -> Column:
    low, needle = F.lower(text), F.lower(value)
    removed = F.length(low) - F.length(F.replace(low, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (removed / F.length(needle)).cast("bigint"))


def norm_rule_name(c: Column) -> Column:
    straight = F.translate(c, "’‘“”–— ", "''\"\"-- ")
    return F.trim(F.regexp_replace(F.lower(straight), r"(?U)\s+", " "))


def split_label(c: Column) -> Column:
    """(label, body) of a deviation: the first line, else a lower-to-upper join, else no label."""
    head = strip(F.substring_index(c, "\n", 1))
    rest = strip(F.substring(c, F.instr(c, "\n") + 1, F.length(c)))
    join = r"(?s)^(.{2,}?[a-z)\]])(?=[A-Z\"“])(.*)$"
    left = F.regexp_extract(c, join, 1)
    right = F.regexp_extract(c, join, 2)
    has_break = F.instr(c, "\n") > 0
    label = F.when(has_break, F.nullif(head, F.lit(""))).when(left != "", strip(left))
    body = F.when(has_break, rest).when(left != "", strip(right)).otherwise(strip(c))
    return F.struct(label.alias("label"), body.alias("body"))


def _line_value(c: Column, form: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern(form, "imd"), group), F.lit(""))


def guidance_fields(c: Column) -> Column:
    """Identity, dependencies, precedence, exhaustion path and source written inside guidance."""
    trailing = r"[.,;]+$"
    depends = _line_value(c, vocab.DEPENDS_LINE)
    refs = F.regexp_extract_all(depends, F.lit(vocab.DEPENDENCY_ITEM), F.lit(1))
    whys = F.regexp_extract_all(depends, F.lit(vocab.DEPENDENCY_ITEM), F.lit(2))
    items = F.filter(
        F.transform(
            F.arrays_zip(refs.alias("ref"), whys.alias("why")),
            lambda x: F.struct(
                F.regexp_replace(x["ref"], trailing, "").alias("ref"),
                F.nullif(strip(x["why"]), F.lit("")).alias("reason"),
                F.lower(x["ref"]).isin("and", "or").alias("joiner"),
            ),
        ),
        lambda x: ~x["joiner"],
    )
    depends_on = F.transform(items, lambda x: F.struct(x["ref"].alias("ref"), x["reason"].alias("reason")))
    return F.struct(
        F.regexp_replace(_line_value(c, vocab.RULE_ID_LINE), trailing, "").alias("rule_id"),
        F.coalesce(depends_on, F.array().cast("array<struct<ref:string,reason:string>>")).alias("depends_on"),
        strip(_line_value(c, vocab.PRECEDENCE_LINE)).alias("precedence"),
        strip(_line_value(c, vocab.EXHAUSTION_LINE)).alias("on_exhaustion"),
        strip(_line_value(c, vocab.SOURCE_LINE)).alias("source"),
        _line_value(c, vocab.SOURCE_LINE, 2).alias("reviewed"),
    )


def absence_answered(standard: Column) -> Column:
    """Whether the position says what happens when the provision is missing."""
    tail = F.regexp_extract(standard, f"(?isU)((?:{vocab.ABSENCE_CLAUSE}).*)$", 1)
    answered = (
        matches(tail, vocab.ABSENCE_ESCALATES)
        | matches(tail, vocab.ABSENCE_ACCEPTABLE)
        | matches(tail, vocab.OPERATIVE_WORDING)
    )
    return F.coalesce((tail != "") & answered, F.lit(False))


def mark_positions(text: Column, mark: str) -> Column:
    """Zero-based offsets of the first character after each match of a pattern for one character."""
    parts = F.split(text, mark, -1)
    ends = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1), F.array(F.lit(0)),
        lambda acc, part: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(part) + 1)),
    )
    return F.slice(ends, 2, F.size(ends))


def evidence_topk(c: Column, n: int = vocab.EVIDENCE_LINES) -> Column:
    return F.slice(c, 1, n)
