"""Scores of answers, as column expressions over words; citation scores over arrays of normal forms."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import citations, fixed
from .text import let, tokens

def _size(c: Column) -> Column:
    return F.size(c).cast("double")


def _ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def _common(a: Column, b: Column) -> Column:
    """How many words the two share, as often as both have them."""
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(times(a, w), times(b, w))).cast("double")


def token_f1(answer: Column, expected: Column) -> Column:
    def score(a: Column, b: Column) -> Column:
        n = _common(a, b)
        return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(let(n, lambda n: harmonic(n / F.size(a), n / F.size(b))))

    return let(tokens(answer), lambda a: let(tokens(expected), lambda b: score(a, b)))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _lcs(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(xs, ys, strict=True)])

    return run(a, b)


def rouge_l(answer: Column, expected: Column) -> Column:
    """struct<precision, recall, f1> of the longest common subsequence of words; zero where either is empty."""
    a, b = tokens(answer), tokens(expected)
    n = _lcs(a, b).cast("double")
    p, r = _ratio(n, F.size(a)), _ratio(n, F.size(b))
    return F.struct(p.alias("precision"), r.alias("recall"), harmonic(p, r).alias("f1"))


def similarity(answer: Column, expected: Column) -> Column:
    """struct<word_precision, word_recall, word_f1, token_f1, bigram_overlap, length_ratio, rouge_l>."""
    pairs = lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda x, y: F.concat(x, F.lit("\x1f"), y))).otherwise(F.array().cast("array<string>"))

    def scores(a: Column, b: Column) -> Column:
        both = _size(F.array_intersect(a, b))
        p, r = _ratio(both, F.size(F.array_distinct(a))), _ratio(both, F.size(F.array_distinct(b)))
        return F.struct(
            p.alias("word_precision"), r.alias("word_recall"), harmonic(p, r).alias("word_f1"), token_f1(answer, expected).alias("token_f1"),
            F.size(F.array_intersect(pairs(a), pairs(b))).alias("bigram_overlap"), (F.char_length(answer) / F.greatest(F.char_length(expected), F.lit(1))).alias("length_ratio"),
        )

    return let(tokens(answer), lambda a: let(tokens(expected), lambda b: scores(a, b))).withField("rouge_l", rouge_l(answer, expected)["f1"])


def terminology(text: Column, jurisdiction: str = "uk") -> Column:
    """struct<legal_term_count, terms_used, terminology_density>."""
    words = F.array_distinct(tokens(text))
    terms = fixed.TERMS.get(jurisdiction, fixed.TERMS["uk"])
    single = F.array_intersect(words, F.array(*[F.lit(t) for t in terms if " " not in t]))
    phrases = F.array_compact(F.array(*[F.when(F.lower(text).rlike(rf"(?U)\b{t}\b"), t) for t in terms if " " in t]))
    used = F.array_sort(F.concat(single, phrases))
    return F.struct(F.size(used).alias("legal_term_count"), used.alias("terms_used"), (F.size(used) / F.greatest(F.size(words), F.lit(1))).alias("terminology_density"))


def quality(text: Column) -> Column:
    """struct<word_count, sentence_count, avg_sentence_length, has_structure, hedging_score>."""
    words = F.size(F.filter(F.split(text, r"(?U)[\s\x1C-\x1F]+"), lambda w: w != ""))
    sentences = F.size(F.filter(F.split(text, "[!.?]+"), lambda s: s.rlike(r"(?U)[^\s\x1C-\x1F]")))
    structured = text.rlike(r"\n\d+\.|\n[*•-]|\n[A-Z][^.]*:|(?U)\b(?:Third|Second|First)(?:ly)?,|In conclusion|To summari[sz]e")
    hedges = F.regexp_count(F.lower(text), F.lit(rf"(?U)\b(?:{'|'.join(sorted(fixed.HEDGES, key=len, reverse=True))})\b"))
    one = F.lit(1)
    return F.struct(words.alias("word_count"), sentences.alias("sentence_count"), (words / F.greatest(sentences, one)).alias("avg_sentence_length"), structured.alias("has_structure"), (hedges / F.greatest(words / 100, F.lit(1.0))).alias("hedging_score"))


def normal_citations(text: Column, legislation: bool = True) -> Column:
    """array<string> of the distinct normal forms in a text."""
    return F.transform(F.filter(citations.citations_of(text), lambda c: F.lit(legislation) | (c["type"] != "legislation")), lambda c: F.coalesce(c["normalised"], c["raw"]))


@lru_cache(citations.HELD)
def _canonical(text: str) -> str:
    found = citations.parse(text)
    return citations.normal_form(found[0]) if len(found) == 1 else " ".join(text.split())


def canonical(expected: Column) -> Column:
    """array<string>: each text's normal form if it is one citation, else the text with single spaces."""

    @F.arrow_udf("array<string>")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else [_canonical(t) for t in r] for r in rows.to_pylist()], pa.list_(pa.string()))

    return run(expected)


def citation_scores(found: Column, expected: Column) -> Column:
    """struct<precision, recall, f1, missing, extra> of arrays of normal forms."""
    a, b = F.array_distinct(found), F.array_distinct(expected)
    n = _size(F.array_intersect(a, b))
    p = F.when(F.size(a) == 0, F.when(F.size(b) == 0, 1.0).otherwise(0.0)).otherwise(n / F.size(a))
    r = _ratio(n, F.size(b), 1.0)
    return F.struct(p.alias("precision"), r.alias("recall"), harmonic(p, r).alias("f1"), F.array_except(b, a).alias("missing"), F.array_except(a, b).alias("extra"))


def grounding(cited: Column, source: Column) -> Column:
    """struct<grounded, ungrounded, grounding_rate>: which cited authorities the source has, by normal form, instrument or, if short, as a whole."""
    found = citations.citations_of(source)
    known = F.concat(F.transform(found, lambda c: F.coalesce(c["normalised"], c["raw"])), F.transform(F.filter(found, lambda c: c["instrument"].isNotNull()), lambda c: c["instrument"]))
    known = F.when(F.char_length(source) <= 300, F.array_append(known, F.trim(F.regexp_replace(source, r"(?U)\s+", " ")))).otherwise(known)
    held = F.array_intersect(cited, known)
    return F.struct(held.alias("grounded"), F.array_except(cited, known).alias("ungrounded"), _ratio(_size(held), F.size(cited), 1.0).alias("grounding_rate"))


def overall(density: Column, *scores: Column) -> Column:
    """Mean of the scores that aren't null and of ten times the density, at most 1."""
    every = F.array_compact(F.array(F.least(density * 10, F.lit(1.0)), *scores))
    return F.aggregate(every, F.lit(0.0), lambda a, x: a + x) / F.size(every)


def phrase(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def has_phrase(text: Column, wanted: Column) -> Column:
    """Whether the words of ``wanted`` stand in a row in the text."""
    target = phrase(wanted)
    return (target != "") & F.contains(F.concat(F.lit(" "), phrase(text), F.lit(" ")), F.concat(F.lit(" "), target, F.lit(" ")))


def chosen_option(answer: Column, options: Column) -> Column:
    """The option that the answer mentions first, the longest if several begin together; else null."""
    padded = F.concat(F.lit(" "), phrase(answer), F.lit(" "))
    place = lambda o: F.struct(F.position(F.concat(F.lit(" "), phrase(o), F.lit(" ")), padded).alias("at"), (-F.length(phrase(o))).alias("less"), o.alias("option"))
    met = F.filter(F.transform(F.filter(options, lambda o: phrase(o) != ""), place), lambda x: x["at"] > 0)
    return F.array_min(met)["option"]
