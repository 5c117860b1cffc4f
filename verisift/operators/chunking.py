"""Chunkers that carry state through a text, as Arrow-batched functions of one row each."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def is_heading(paragraph: str) -> bool:
    return len(paragraph) <= 120 and len(paragraph.split()) <= 12 and not paragraph.endswith(".") and bool(paragraph)


def section_chunks(text: str | None, target: int = 400, slack: int = 50, overlap: int = 40) -> list[tuple[str, str, int, int]]:
    """(section, text, start, end) of each chunk.

    A short paragraph without a full stop is a heading: it ends the chunk and
    names the next. Paragraphs gather until ``target`` words; bodies up to
    ``slack`` beyond stay whole, longer ones are cut into windows that overlap.
    """
    target = min(450, max(350, target))
    out: list[tuple[str, str, int, int]] = []
    section, held, start = "body", [], 0

    def flush(end: int) -> None:
        nonlocal held
        words = " ".join(held).split()
        if words:
            if len(words) <= target + slack:
                out.append((section, " ".join(words), start, end))
            else:
                at = 0
                while True:
                    out.append((section, " ".join(words[at : at + target]), start, end))
                    if at + target >= len(words):
                        break
                    at += target - overlap
        held = []

    at, last = 0, 0
    for piece in [*_PARAGRAPH.finditer(text or ""), None]:
        stop = piece.start() if piece else len(text or "")
        raw = (text or "")[at:stop]
        paragraph = raw.strip()
        if paragraph:
            if is_heading(paragraph):
                flush(last)
                section, start = paragraph, stop
            else:
                if not held:
                    start = at
                held.append(paragraph)
                last = stop
                if sum(len(h.split()) for h in held) >= target:
                    flush(stop)
        at = piece.end() if piece else stop
    flush(len(text or ""))
    return out


def packed_sentences(text: str | None, limit: int) -> list[str]:
    """Sentences packed greedily up to ``limit`` words; longer ones are cut by words."""
    out: list[str] = []
    held: list[str] = []
    for sentence in _SENTENCE.split((text or "").strip()):
        words = sentence.split()
        if held and len(held) + len(words) > limit:
            out.append(" ".join(held))
            held = []
        while len(words) > limit:
            out.append(" ".join(words[:limit]))
            words = words[limit:]
        held += words
    if held:
        out.append(" ".join(held))
    return out


def split_strategy(given: Column, answer: Column, limit: int = 400, overhead: int = 20) -> Column:
    """How a row is cut, from the words of its input and output; rows without either are skipped."""
    return (
        F.when((given == 0) | (answer == 0), "skip").when(given + answer + overhead <= limit, "single_chunk").when((given > limit) & (answer <= limit), "split_input_keep_output")
        .when((given <= limit) & (answer > limit), "keep_input_split_output").otherwise("split_both_fields")
    )


def dialogue_parts(question: str, context: str, answer: str, limit: int = 400, overhead: int = 20) -> list[tuple[str, str]]:
    """(strategy, text): whole if it fits; else the longer side is split, or both."""
    q, c, a = (len((x or "").split()) for x in (question, context, answer))
    head, body = " ".join(x for x in (question, context) if x), answer or ""
    if q + c + a + overhead <= limit:
        return [("single", f"{head} {body}".strip())]
    if a + overhead <= limit // 2:
        return [("input_split", f"{p} {body}".strip()) for p in packed_sentences(head, 200)]
    if q + c + overhead <= limit // 2:
        ref = " ".join(head.split()[:15])
        return [("output_split", f"{ref} {p}".strip()) for p in packed_sentences(body, 200)]
    return [("both_split", p) for x in (head, body) for p in packed_sentences(x, 150)]


def shrink(fields: dict[str, str], limit: int = 400, step: int = 5) -> dict[str, str]:
    """Shorten the longest field by ``step`` words until all fit."""
    words = {k: (v or "").split() for k, v in fields.items()}
    while sum(map(len, words.values())) > limit:
        k = max(words, key=lambda x: (len(words[x]), x))
        words[k] = words[k][: max(0, len(words[k]) - step)]
    return {k: " ".join(v) for k, v in words.items()}


def explode_rows(df: DataFrame, make: Callable[..., list[tuple]], inputs: list[str], keep: list[str], schema: str) -> DataFrame:
    """``make`` of the inputs of each row gives rows; ``keep`` columns and a running number go with them."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [
                (*[r[k] for k in keep], i, *made) for r in pdf.to_dict("records") for i, made in enumerate(make(*[r[c] for c in inputs]))
            ]
            yield pd.DataFrame(rows, columns=names)

    names = [x.strip().split()[0] for x in schema.split(",")]
    return df.select(*dict.fromkeys([*keep, *inputs])).mapInPandas(run, schema)
