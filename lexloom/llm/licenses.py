"""Licence scan: ordered signature rules behind a keyword filter.

A text is reduced to its words (lower-case ASCII letters, digits and anything beyond ASCII). Base
phrases and rules are looked up in these words joined by single spaces. A rule runs only where an
automaton has seen its keyword. A detection within the words of a stronger one is suppressed.

Defined cases: a null text has no words and no labels; empty label lists are empty strings, and
first_word and last_word null without a base phrase; repeated rows are scanned each; a text of any
length is scanned whole; an empty table gives an empty result; columns beside the id and text play no part;
of detections as strong and as long the earlier rule's holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, columns, sliced, table
from .license_rules import rules

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: ASCII other than 0-9, A-Z and a-z becomes a space, A-Z lower case; bytes from 0x80 stay.
WORDS = bytes(c if c > 127 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Certainty by priority: whole grants and identifiers, versioned names, names, hints.
CERTAINTY = {10: 1.0, 16: 1.0, 18: 0.5, 20: 0.95, 22: 0.95, 25: 0.9, 30: 0.85, 40: 0.8, 50: 0.6, 60: 0.5, 70: 0.3}
#: Labels that say nothing that a stronger detection beside them doesn't.
HINTS = {"spdx", "other-license", "copyright"}
SPANS = "detections array<struct<label:string,rule:int,first_word:int,n_words:int,priority:int>>"
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, {SPANS}"


@cache
def _automaton():
    import ahocorasick

    found, by_key = ahocorasick.Automaton(), {}
    for k, (_, _, keyword, _) in enumerate(rules()):
        by_key.setdefault(keyword, []).append(k)
    for phrase in BASE:
        by_key.setdefault(phrase, [])
    for keyword, own in by_key.items():
        found.add_word(keyword, own)
    found.make_automaton()
    return found, [(p, label, re.compile("(?<![^ ])(?:" + pattern.replace(r"\S", "[^ ]") + ")(?![^ ])")) for p, label, _, pattern in rules()]


#: Every keyword and base phrase holds one of these, so that most texts need no automaton.
GATES = (b"licen", b"copy", b"gnu", b"gpl", b"gfdl", b"cc by", b"cc0", b"spdx", b"apache", b"creative", b"public domain", b"all rights", b"proprietary", b"confidential", b"bsd", b"mit ", b"redistribution", b"permission", b"neither the name", b"unencumbered", b"altered source", b"fuck", b"wtfpl", b"any later version", b"you may not use", b"openrail", b"creativeml", b"bloom rail", b"gemma", b"mozilla", b"opensource", b"scripts sil", b"x11", b"ncsa", b"same terms as perl", b"used for good", b"cecill", b"mulan", b"artistic", b"affero", b"polyform", b"lesser general", b"library general", b"common development", b"open data commons", b"european union public", b"open government", b"beer ware")
_GATE = re.compile(b"|".join(GATES))


def scan(text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, int, int]]]:
    """(words, base places as (word, label), surviving detections as (label, rule, first word, words, priority))."""
    words = text.translate(WORDS).split()
    joined = b" ".join(words)
    if not _GATE.search(joined):
        return len(words), [], []
    found, compiled = _automaton()
    line = joined.decode("utf-8", "replace")
    wanted, base = set(), []
    for end, own in found.iter(line):
        wanted.update(own)
    starts: list[int] | None = None

    def word_at(place: int) -> int:
        nonlocal starts
        if starts is None:
            starts = [0, *(m.end() for m in re.finditer(" ", line))]
        from bisect import bisect_right

        return bisect_right(starts, place) - 1

    for phrase, label in BASE.items():
        at = line.find(phrase)
        while at >= 0:
            end = at + len(phrase)
            if (at == 0 or line[at - 1] == " ") and (end == len(line) or line[end] == " "):
                base.append((word_at(at), label))
            at = line.find(phrase, at + 1)
    hits = []
    for k in sorted(wanted):
        priority, label, pattern = compiled[k]
        for m in pattern.finditer(line):
            hits.append((priority, m.start() - m.end(), k, m.start(), m.end(), label))
    return len(words), base, [(label, k, word_at(a), line.count(" ", a, b) + 1, p) for p, _, k, a, b, label in resolved(hits)]


def resolved(hits: list[tuple]) -> list[tuple]:
    """Strongest first; a hit goes if its span lies within the span of a stronger one that stayed. Sorted by place.

    Spans that stayed are kept by start with the furthest end so far, so that each test is a binary search.
    """
    from bisect import bisect_right, insort

    kept: list[tuple] = []
    levels: list[tuple[int, int]] = []  # (start, end) with rising ends: none within another
    for hit in sorted(hits):
        a, b = hit[3], hit[4]
        k = bisect_right(levels, (a, float("inf")))
        if k and levels[k - 1][1] >= b:
            continue
        kept.append(hit)
        while k < len(levels) and levels[k][1] <= b:
            levels.pop(k)
        if k and levels[k - 1][0] == a:
            levels.pop(k - 1)
        insort(levels, (a, b))
    return sorted(kept, key=lambda h: (h[3], h[4], h[2]))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(pa.struct([("label", pa.string()), *((n, pa.int32()) for n in ("rule", "first_word", "n_words", "priority"))])))])
    for batch in sliced(batches, "text"):
        out: list[tuple] = []
        for text in as_bytes(batch, "text"):
            n, base, spans = scan(text)
            labels = {label for _, label in base} | ({s[0] for s in spans} - HINTS or {s[0] for s in spans})
            places = [w for w, _ in base]
            score = max([0.8 * bool(base), *(CERTAINTY[s[4]] for s in spans)])
            out.append((n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), float(score), [dict(zip(("label", "rule", "first_word", "n_words", "priority"), s, strict=True)) for s in spans]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), list(schema)[1:], strict=True))], schema=schema)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, with the surviving detections as spans of words. No shuffle."""
    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(_scanned, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")
