"""Text functions: tokens, redaction, hashes, field extraction. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words in Python, as ``word_count`` takes them.
WORDS = re.compile(r"[^ \t\n\v\f\r]+")

# What is redacted, in this order.
REDACTIONS = (
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[REDACTED_EMAIL]"),
    (r"\b(?:\+?\d[\d .()-]{7,}\d)\b", "[REDACTED_PHONE]"),
    (r"(?i)\b(?:MRN|patient(?:\s+id)?|medicare)\s*[:#-]?\s*[A-Z0-9-]{4,}\b", "[REDACTED_PATIENT_ID]"),
    (r"(?i)\b(?:DOB|date of birth)\s*[:#-]?\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", "[REDACTED_DOB]"),
)
# Headings at which an article's tail begins.
TAIL_HEADS = r"references|bibliography|acknowledg(?:e)?ments?|author contributions?|appendix"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def tokens(text: Column) -> Column:
    """Lower-case white-space tokens."""
    return words(F.lower(text))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def first_words_marked(text: Column, n: int) -> Column:
    """First n words, with a mark where something is left out."""
    return F.when(F.size(words(text)) > n, F.concat(first_words(text, n), F.lit("..."))).otherwise(F.array_join(words(text), " "))


def fts_terms(query: Column, most: int = 64) -> Column:
    found = F.regexp_extract_all(F.lower(query), F.lit(r"[a-z0-9][a-z0-9_.+/-]*"), F.lit(0))
    return F.slice(F.array_distinct(found), 1, most)


def redact(text: Column) -> Column:
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def redact_nested(value: Column, kind: T.DataType) -> Column:
    """Redact every string inside arrays, maps and structs."""
    if isinstance(kind, T.StringType):
        return redact(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact_nested(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: redact_nested(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.struct(*[redact_nested(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return value


def count_in(low: Column, stems: tuple[str, ...]) -> Column:
    """How many of the stems occur in a text that is lower-cased already."""
    return sum((low.contains(s).cast("int") for s in stems), F.lit(0))


def count_stems(text: Column, stems: tuple[str, ...]) -> Column:
    """How many of the stems occur in the lower-cased text."""
    return count_in(F.lower(F.coalesce(text, F.lit(""))), stems)


def has_any(text: Column, stems: tuple[str, ...]) -> Column:
    return count_stems(text, stems) > 0


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


def strip_reference_tail(text: Column) -> Column:
    """Text before the first line that begins with a heading of the tail, with runs of blank lines squeezed."""
    head = F.get(F.split(text, rf"(?i)\n(?:{TAIL_HEADS})\b", 2), F.lit(0))
    return F.regexp_replace(F.regexp_replace(head, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def content_hash(*cols: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in cols]))


def labelled(text: Column, label: str, until: str | None = None) -> Column:
    """The text after ``label:``, up to ``until:`` or the end; lines included."""
    tail = rf"(?=\s*{until}:)" if until else "$"
    return F.trim(F.regexp_extract(text, rf"(?is){label}:\s*(.*?)\s*{tail}", 1))


def header_seconds(value: Column, now: Column) -> Column:
    """Seconds that a retry or reset header asks to wait: a number, a moment in epoch seconds, ``ms``, ``s`` or ``m``, or an HTTP date; null if unreadable."""
    raw = F.trim(value)
    number = lambda c: c.try_cast("double")
    whole, low = number(raw), F.lower(raw)
    moment = F.try_to_timestamp(F.regexp_replace(raw, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    short = number(F.substring(raw, 1, F.length(raw) - 1))
    wait = (
        F.when(raw == "", None).when(whole > 1_000_000_000, whole - F.unix_timestamp(now)).when(whole.isNotNull(), whole)
        .when(low.endswith("ms"), number(F.substring(raw, 1, F.length(raw) - 2)) / 1000.0).when(low.endswith("s"), short).when(low.endswith("m"), short * 60.0)
        .otherwise((F.unix_timestamp(moment) - F.unix_timestamp(now)).cast("double"))
    )
    return F.when(wait.isNotNull(), F.greatest(F.lit(0.0), wait))


#: Headers that say when to ask again, in the order they are believed.
RETRY_HEADERS = ("retry-after-ms", "Retry-After-Ms", "retry-after", "Retry-After", "x-ratelimit-reset-requests", "x-ratelimit-reset-tokens", "x-ratelimit-reset")


def retry_after(headers: Column, now: Column) -> Column:
    """Seconds to wait by the first header of a map that can be read."""
    return F.coalesce(*[header_seconds(F.try_element_at(headers, F.lit(h)), now) for h in RETRY_HEADERS])


def compose(title: Column, abstract: Column, body: Column, total: Column) -> Column:
    """Title, abstract and body within ``total`` words: the title up to 32, the abstract up to a quarter of the total and 64 at
    least, the body what is left; a part's heading counts once for the abstract. What has no room is left out."""
    t, a, b = (words(F.coalesce(x, F.lit(""))) for x in (title, abstract, body))
    cut = lambda w, n: F.array_join(F.slice(w, 1, F.greatest(n, F.lit(0))), " ")
    budget = F.greatest(total, F.lit(0)).cast("int")
    n_title = F.least(F.size(t), F.lit(32), budget)
    after = budget - n_title
    has_abstract = (F.size(a) > 0) & (after > 0)
    n_abstract = F.least(F.size(a), F.greatest(F.lit(64), F.floor(total / 4).cast("int")), after)
    rest = F.when(has_abstract, after - n_abstract - 1).otherwise(after)
    return F.concat_ws(
        "\n\n", F.when(n_title > 0, cut(t, n_title)), F.when(has_abstract, F.concat(F.lit("Abstract\n\n"), cut(a, n_abstract))),
        F.when((F.size(b) > 0) & (rest > 0), F.concat(F.lit("Body excerpt\n\n"), cut(b, F.least(F.size(b), rest)))),
    )
