"""Text cleaning, tokens, answers, citations and prompts as Column functions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line and what is blank, as Java character classes.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
SPACE = r"[\s\x1C-\x1F]"
#: Letters that Java writes as two capitals though they have one of their own, and that one.
NARROW = "ßᾀᾁᾂᾃᾄᾅᾆᾇᾐᾑᾒᾓᾔᾕᾖᾗᾠᾡᾢᾣᾤᾥᾦᾧᾳῃῳ"
WIDE = "ẞᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚᾛᾜᾝᾞᾟᾨᾩᾪᾫᾬᾭᾮᾯᾼῌῼ"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{Cc}&&[^\n\t]]", "")


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, r"([a-z])-\n([a-z])", "$1$2")


def normalize_whitespace(text: Column) -> Column:
    """One line end, single blanks, no blanks before line ends; one trailing line end goes."""
    lines = F.regexp_replace(F.regexp_replace(text, LINE_END, "\n"), r"\n\z", "")
    return F.regexp_replace(F.regexp_replace(lines, r"[ \t]+", " "), rf"(?U)[{SPACE}&&[^\n]]+(?=\n|\z)", "")


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n")


def clean_text(text: Column) -> Column:
    return strip(collapse_blank_lines(normalize_whitespace(dehyphenate(strip_control(text)))))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:'[a-z]+)?"), F.lit(0))


# Typographic forms and what they are folded to.
FOLDS = {" ": " ", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."}


def fold(text: Column) -> Column:
    """The form in which quotes are compared. Spark has no case folding; lower case and sharp s
    cover the letters of this corpus."""
    for fancy, plain in FOLDS.items():
        text = F.replace(text, F.lit(fancy), F.lit(plain))
    text = F.replace(text, F.lit("--"), F.lit("-"))
    return F.replace(F.lower(strip(F.regexp_replace(text, rf"(?U){SPACE}+", " "))), F.lit("ß"), F.lit("ss"))


def normalize_answer(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return strip(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), rf"(?U){SPACE}+", " "))


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_answer(text), " "), lambda x: x != "")


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("int")


def token_f1(prediction: Column, gold: Column) -> Column:
    """Multiset overlap: each distinct token counts as often as both sides have it."""
    a, b = answer_tokens(prediction), answer_tokens(gold)
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    same = F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    value = F.lit(2.0) * same / (F.size(a) + F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(value)


def best(score, prediction: Column, golds: Column) -> Column:
    """The largest score over an array of golds."""
    return F.array_max(F.transform(golds, lambda g: score(prediction, g)))


def golds(answer: Column, aliases: Column) -> Column:
    """The answer and its aliases; raises without an answer."""
    missing = F.raise_error(F.lit("a sample has no answer")).cast("string")
    return F.concat(F.array(F.when(F.coalesce(answer, F.lit("")) == "", missing).otherwise(answer)), F.coalesce(aliases, F.array().cast("array<string>")))


def template_fields(template: str) -> list[str]:
    """The named fields of a format template, in order; positional and nested ones raise."""
    fields = [name for _, name, _, _ in Formatter().parse(template) if name is not None]
    if wrong := [f for f in fields if not f.isidentifier()]:
        raise ValueError(f"a template may only name plain fields, not {wrong}")
    return list(dict.fromkeys(fields))


def check_record_template(template: str, carried: list[str]) -> None:
    """Raises where a record template names a field that records don't carry."""
    if unknown := sorted(set(template_fields(template)) - set(carried)):
        raise ValueError(f"the template names {unknown}; records carry {sorted(carried)}")


def contains_answer(response: Column, golds: Column) -> Column:
    padded = F.concat(F.lit(" "), normalize_answer(response), F.lit(" "))
    return F.exists(golds, lambda g: (normalize_answer(g) != "") & F.contains(padded, F.concat(F.lit(" "), normalize_answer(g), F.lit(" "))))


def words_of_question(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(r"[a-z0-9]+(?:\.[0-9]+)?"), F.lit(0))


def content_overlap(question: Column, spans: Column, stop: list[str], exclude: Column | None = None) -> Column:
    """Share of a question's topic words that its spans have; 0 without topic words."""
    seen = words_of_question(F.array_join(spans, " "))
    topic = lambda w: ~w.isin(stop) & ~w.rlike(r"^(?:(?:19|20)\d\d|\d{1,2}|fy\d*|q[1-4])$")
    words = F.filter(words_of_question(question), topic)
    if exclude is not None:
        words = F.filter(words, lambda w: ~F.array_contains(exclude, w))
    return F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: F.array_contains(seen, w))), F.size(words)), F.lit(0.0))


def names_company(question: Column, ticker: Column, aliases: Column) -> Column:
    word = F.concat(F.lit(r"\b\Q"), ticker, F.lit(r"\E\b"))
    return F.regexp_like(question, word) | F.arrays_overlap(words_of_question(question), aliases)


def lead_figures(text: Column) -> Column:
    """Amounts, percentages, decimals and thousands."""
    found = F.regexp_extract_all(text, F.lit(r"\$?\d[\d,]*(?:\.\d+)?(?:\s*(?:%|percent|billion|million))?"), F.lit(0))
    trimmed = F.transform(found, lambda x: F.regexp_replace(F.trim(x), r"[,.]+$", ""))
    return F.filter(trimmed, lambda x: x.rlike(r"[$%]|\d\.\d|\d,\d{3}|billion|million|percent"))


def leak_figures(text: Column) -> Column:
    """Distinct figures specific enough to identify a fact."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\$?\d[\d,]*(?:\.\d+)?\s*(?:%|percent|billion|million|thousand)?"), F.lit(0))
    tokens = F.transform(found, lambda x: F.regexp_replace(F.trim(fold(x)), r"[,.]+$", ""))
    digits = lambda x: F.length(F.regexp_replace(x, r"\D", ""))
    telling = lambda x: x.rlike(r"\$|billion|million|thousand") | (digits(x) >= 4) | (x.rlike("%|percent") & (digits(x) >= 3))
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda x: ~x.rlike(r"^(?:19|20)\d\d$") & telling(x))))


def digit_ratio(text: Column) -> Column:
    bare = F.regexp_replace(text, rf"(?U){SPACE}", "")
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(bare, r"\P{Nd}", "")), F.length(bare)), F.lit(0.0))


def pipe_ratio(text: Column) -> Column:
    return F.coalesce(F.try_divide(F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))), F.length(text)), F.lit(0.0))


# --- citations and prompts

_MARKER = r"\[(\d+(?:\s*,\s*\d+)*)\]"


def _cited(answer: Column) -> Column:
    groups = F.regexp_extract_all(answer, F.lit(_MARKER), F.lit(1))
    return F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda x: F.trim(x).cast("int"))


def cited_passages(answer: Column, count: Column) -> Column:
    return F.array_distinct(F.filter(_cited(answer), lambda n: (n >= 1) & (n <= count)))


def invalid_citations(answer: Column, count: Column) -> Column:
    return F.array_distinct(F.filter(_cited(answer), lambda n: (n < 1) | (n > count)))


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]*" + _MARKER, "")


def delimit_passage(block: Column) -> Column:
    """In passage tags, with look-alikes of the tag escaped."""
    gap = r"[\s​-‍⁠﻿]*"
    escaped = F.regexp_replace(block, rf"(?iU)[<＜]({gap}[/／]?{gap}passage\b)", "&lt;$1")
    return F.concat(F.lit("<passage>\n"), escaped, F.lit("\n</passage>"))


def citation_label(header: Column, document_id: Column, page: Column) -> Column:
    label = F.coalesce(F.when(header != "", header), document_id)
    return F.when(page.isNotNull(), F.concat(label, F.lit(" (p."), page.cast("string"), F.lit(")"))).otherwise(label)


def format_passage(number: Column, label: Column, context: Column, text: Column) -> Column:
    with_context = F.when(context.isNotNull() & (context != ""), F.concat(F.lit("Context: "), context, F.lit("\n"))).otherwise("")
    return F.concat(F.lit("Passage ["), number.cast("string"), F.lit("] (source: "), label, F.lit("):\n"), with_context, text)


def index_text(header: Column, context: Column, text: Column) -> Column:
    return F.array_join(F.filter(F.array(header, context, text), lambda x: x.isNotNull() & (x != "")), "\n\n")


# --- identities

def chunk_id(document_id: Column, index: Column) -> Column:
    return F.concat(document_id, F.lit("::chunk"), index.cast("string"))


def document_id(path: Column, page: Column) -> Column:
    return F.when(page.isNotNull(), F.concat(path, F.lit("#page="), page.cast("string"))).otherwise(path)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def stable_hash(*columns: Column) -> Column:
    """Of a record: its JSON with keys in the order given, nulls kept."""
    return short_hash(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat(*[F.concat(p, F.lit("\0")) for p in parts]), 256)


# --- dates and templates

def date_number(date: Column) -> Column:
    return F.date_format(date, "yyyyMMdd").cast("int")


def spell_date(date: Column) -> Column:
    return F.date_format(date, "MMMM d, yyyy")


def render(template: str, **fields: Column) -> Column:
    """The template with its fields filled in, null if any is null or empty."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        name, _, spec = name.partition(":")
        if name not in fields:
            raise ValueError(f"template names unknown field {name!r}")
        value = spell_date(fields[name]) if spec == "date" else fields[name].cast("string")
        parts += [F.lit(before), F.when(value != "", value)]
    return F.concat(*parts, F.lit(rest))


# --- replies and rendered tables

def upper(text: Column) -> Column:
    """Upper case character by character: none becomes two, as ß does in Java."""
    single = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, NARROW, WIDE))
    each = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), single), "")
    return F.when(F.length(F.upper(text)) == F.length(text), F.upper(text)).otherwise(each)


def first_word(reply: Column) -> Column:
    return upper(F.regexp_replace(F.get(F.split(strip(reply), rf"(?U){SPACE}+"), F.lit(0)), r"^[.,:!*]+|[.,:!*]+$", ""))


def pass_fail(reply: Column) -> Column:
    word = upper(F.get(F.split(strip(reply), rf"(?U){SPACE}+"), F.lit(0)))
    return F.when(word == "PASS", True).when(word == "FAIL", False)


def clean_query_line(line: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.trim(line), "^[-*\u2022]+", ""))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(bare, r"^\d+\s*[.):-]\s*", "")), r'^"+|"+$', ""))


def is_table_row(line: Column) -> Column:
    return line.rlike(r"^\s*\|")


def table_cells(line: Column) -> Column:
    bare = strip(line)
    inner = F.when(bare.startswith("|"), F.regexp_replace(bare, r"(?s)^\|(.*).$", "$1")).otherwise(line)
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda c: F.replace(strip(c), F.lit("\\|"), F.lit("|")))


def figure_key(cell: Column) -> Column:
    return F.replace(cell, F.lit("$"), F.lit(""))


def is_figure(cell: Column) -> Column:
    return cell.rlike(r"^[($\u20ac\u00a3\u00a5]*-?[\d,]*\.?\d+[)%]*$") & ~cell.rlike(r"^(?:19|20)\d\d$")


def count_headings(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?m)^#{2,6} \S"))


def extension_kind(path: Column) -> Column:
    """The loader that a path's extension names; null: none."""
    suffix = F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))
    return F.when(suffix == ".pdf", "pdf").when(suffix.isin(".md", ".markdown"), "markdown").when(suffix == ".txt", "text").when(suffix == ".jsonl", "passages")


def passage_text(title: Column, text: Column) -> Column:
    return F.when(title != "", F.concat_ws(" ", title, text)).otherwise(text)


def build_list(reply: Column) -> Column:
    """A reply's cleaned lines, each text once whatever its case, in order."""
    lines = F.filter(F.transform(F.split(reply, "\n"), clean_query_line), lambda x: x != "")
    low = F.transform(lines, lambda x: F.lower(x))
    return F.filter(lines, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
