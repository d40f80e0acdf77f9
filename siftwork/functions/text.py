"""Text functions: Column in, Column out, all of them JVM expressions but normalize_unicode."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Typographic forms and their plain spelling (fixed values).
TYPOGRAPHY = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
    "‘": "'", "’": "'", "“": '"', "”": '"',
    "–": "-", "—": "-", "…": "...", "\u00a0": " ",
}
#: Words left out of lexical matching (fixed values).
STOPWORDS = (
    "a an and are as at be by for from has have in is it its of on or that the to was were will with within must may any all not this these"
).split()
#: A line that is a page number; the sentence of a refusal, and how else one may begin (fixed values).
PAGE_LINE = r"(?i)^\s*(?:page\s+)?[-–—\[\(]?\s*\d{1,4}\s*(?:/\s*\d{1,4})?\s*[-–—\]\)]?\s*$"
REFUSAL = "i could not find information about this in the provided documents"
REFUSAL_START = "i could not find"
#: Headings: Markdown, numbered, capitals; citations in three kinds of brackets (fixed values).
MARKDOWN, NUMBERED, CAPITALS = r"^#{1,6}\s+(.{1,120})$", r"^(\d+(?:\.\d+)*)\.?\s+([A-Z][^.\n]{2,110})$", r"^[A-Z][A-Z0-9 &/,'\-]{3,80}$"
CITATION = r"[\[【［](\d{1,2})(?:[^\]】］\[【［]{0,40})?[\]】］]"
#: Marks that count towards tokens (fixed values).
MARKS = ".,;:!?()[]{}\"'/-"


def normalize_unicode(text: Column) -> Column:
    """NFKC; no built-in does it."""

    @F.pandas_udf("string")
    def nfkc(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return nfkc(text)


def fix_ligatures(text: Column) -> Column:
    for form, plain in TYPOGRAPHY.items():
        text = F.replace(text, F.lit(form), F.lit(plain))
    return text


def join_hyphenated(text: Column) -> Column:
    """A word broken over a line end becomes whole."""
    return F.regexp_replace(text, r"([a-z])-\s*\n\s*([a-z])", "$1$2")


def collapse_whitespace(text: Column) -> Column:
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    text = F.regexp_replace(text, "[ \t\u00a0]{2,}", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_page_numbers(text: Column) -> Column:
    kept = F.filter(F.split(text, "\n"), lambda line: ~F.rlike(line, F.lit(PAGE_LINE)))
    return F.array_join(kept, "\n")


def strip_lines(text: Column, banned: Column) -> Column:
    """Without the lines whose trimmed form is in the array `banned`."""
    kept = F.filter(F.split(text, "\n"), lambda line: ~F.coalesce(F.array_contains(banned, F.trim(line)), F.lit(False)))
    return F.array_join(kept, "\n")


def clean(text: Column, banned: Column | None = None, nfkc: bool = True) -> Column:
    """The cleaning steps in their order; a step that is off is left out."""
    text = normalize_unicode(text) if nfkc else text
    text = join_hyphenated(fix_ligatures(text))
    text = strip_lines(text, banned) if banned is not None else text
    return collapse_whitespace(strip_page_numbers(text))


def tokenize(text: Column, stopwords: bool = True) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOPWORDS)) if stopwords else found


def count_tokens(text: Column) -> Column:
    """A model-free estimate: 1.33 per word and a quarter per mark, at least 1 for any text."""
    words = F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+"))
    marks = F.length(text) - F.length(F.translate(text, MARKS, ""))
    estimate = F.floor(words * F.lit(1.33)) + F.floor(marks / 4)
    return F.when(F.length(text) == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), estimate))


def title_case(text: Column) -> Column:
    """A capital after everything that is no letter, small letters after letters."""
    letters = F.split(text, "")
    after = lambda i: F.rlike(F.try_element_at(letters, i), F.lit(r"\p{L}"))
    return F.array_join(F.transform(letters, lambda c, i: F.when((i > 0) & after(F.greatest(i, F.lit(1))), F.lower(c)).otherwise(F.upper(c))), "")


def heading(line: Column) -> Column:
    """The heading that a line is, or null: Markdown, then numbered, then capitals of up to 12 words."""
    short = F.trim(line)
    fit = (F.length(short) > 0) & (F.length(short) <= 120)
    mark = F.trim(F.regexp_extract(short, MARKDOWN, 1))
    numbered = F.trim(F.concat_ws(" ", F.nullif(F.regexp_extract(short, NUMBERED, 1), F.lit("")), F.nullif(F.regexp_extract(short, NUMBERED, 2), F.lit(""))))
    capitals = F.rlike(short, F.lit(CAPITALS)) & (F.size(F.split(short, " +")) <= 12)
    return F.when(fit, F.coalesce(F.nullif(mark, F.lit("")), F.nullif(numbered, F.lit("")), F.when(capitals, title_case(short))))


def is_noise(text: Column, least: int = 30, most_marks: float = 0.8) -> Column:
    alnum = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))
    return (F.length(text) < least) | ((1 - alnum / F.nullif(F.length(text), F.lit(0))) > most_marks)


def slug(path: Column) -> Column:
    stem = F.regexp_replace(path, r"\.[^./]+$", "")
    flat = F.lower(F.regexp_replace(F.regexp_replace(stem, r"[^a-zA-Z0-9]+", "_"), r"^_+|_+$", ""))
    return F.coalesce(F.nullif(flat, F.lit("")), F.lit("doc"))


def title(path: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]+$", "")
    return title_case(F.translate(stem, "_-", "  "))


def span_form(text: Column) -> Column:
    """Lower case with single spaces, for matching spans in texts."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def normalize_citations(text: Column) -> Column:
    """[n], full-width and lenticular brackets with a short suffix, to [n] without leading zeros."""
    text = F.regexp_replace(text, CITATION, "[$1]")
    return F.regexp_replace(text, r"\[0(\d)\]", "[$1]")


def citations(text: Column) -> Column:
    """Distinct cited numbers in order of first appearance."""
    found = F.regexp_extract_all(normalize_citations(text), F.lit(r"\[(\d{1,2})\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def validate_citations(text: Column, sources: Column) -> Column:
    """(valid ids, text without the markers of others)."""
    every = citations(text)
    valid = F.filter(every, lambda n: n.between(F.lit(1), sources))
    wrong = F.filter(every, lambda n: ~n.between(F.lit(1), sources))
    kept = F.aggregate(wrong, normalize_citations(text), lambda acc, n: F.replace(acc, F.concat(F.lit("["), n.cast("string"), F.lit("]")), F.lit("")))
    tidy = F.regexp_replace(F.regexp_replace(kept, "[ \t]{2,}", " "), r"^\s+|\s+$", "")
    return F.struct(valid.alias("valid"), tidy.alias("text"))


def is_refusal(text: Column) -> Column:
    """The sentence of a refusal anywhere, or an answer that begins as one."""
    plain = F.regexp_replace(span_form(text), r"\.+$", "")
    return F.contains(plain, F.lit(REFUSAL)) | F.startswith(plain, F.lit(REFUSAL_START))


def parse_judgement(raw: Column) -> Column:
    """The judge's JSON object anywhere in a reply; what cannot be read counts as a failure."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    read = F.from_json(body, "faithful int, relevant int, unsupported_claim string", {"mode": "PERMISSIVE"})
    ok = read["faithful"].isNotNull()
    return F.struct(
        F.coalesce(read["faithful"], F.lit(0)).alias("faithful"),
        F.coalesce(read["relevant"], F.lit(0)).alias("relevant"),
        F.when(ok, F.substring(F.coalesce(read["unsupported_claim"], F.lit("")), 1, 200)).otherwise("unparseable").alias("claim"),
    )


def strip_html(markup: Column) -> Column:
    """Tags to line ends, scripts and styles away, the common entities decoded."""
    text = F.regexp_replace(markup, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>", "")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", "\n")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text
