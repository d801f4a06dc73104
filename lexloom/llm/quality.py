"""Quality rules: base counts over words and lines, and bands on what public tokenisers make of a text.

A text's words are encoded with a SentencePiece vocabulary that falls back to bytes and with a byte-level
one for many languages. Characters per token of each, tokens per word, the share of byte tokens, the entropy of the
text's tokens and the share of its most frequent token must lie within bands that depend on the language or,
where that is unknown, on the script. The bands of languages are those that fit_bands() finds on labelled rows whose
crc32(doc_id as text) mod 4 is not 2; those of scripts are set wide by hand, as no labelled rows are known for them.

Defined cases: a null or blank text has no words, fails the base rule and isn't kept; a null or unknown
language takes its script's band, of scripts with as many letters the first of SCRIPTS; a whole text is one unit,
however long; repeated rows are judged each; an empty table gives an empty result; columns beside those named come
through keep_good() whatever their names, and play no part. The vocabularies' folder must be there on every executor.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, columns, crc_mod, sliced, table

TOKENIZERS = "/opt/tokenizers"
MODEL, BYTE_MODEL = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
# fixed value: how the byte-level vocabulary splits a text before its merges
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 0.5


@dataclass(frozen=True)
class Band:
    chars_per_token: tuple[float, float]
    chars_per_byte_level_token: float
    tokens_per_word: tuple[float, float]
    byte_share: float
    entropy: float
    top_share: float

    def holds(self, chars: int, words: int, tokens: int, others: int, of_bytes: int, entropy: float, top: float) -> bool:
        a, b = self.chars_per_token
        c, d = self.tokens_per_word
        return a * tokens <= chars <= b * tokens and self.chars_per_byte_level_token * others <= chars and c * words <= tokens <= d * words and of_bytes <= self.byte_share * tokens and entropy >= self.entropy and top <= self.top_share


#: By language, then by script for other languages.
BANDS = {
    "en": Band((1.90, 6.5), 1.98, (1.0, 2.83), 0.05, 5.46, 0.099),
    "de": Band((1.96, 6.5), 2.06, (1.0, 3.04), 0.05, 5.52, 0.109),
    "fr": Band((1.70, 6.5), 1.79, (1.0, 3.47), 0.05, 5.38, 0.110),
    "es": Band((1.71, 6.5), 1.83, (1.0, 3.18), 0.05, 5.50, 0.112),
    "latin": Band((1.4, 7.0), 1.4, (1.0, 3.6), 0.10, 5.0, 0.18),
    "cyrillic": Band((1.2, 5.0), 0.9, (1.0, 6.0), 0.10, 5.0, 0.18),
    "greek": Band((0.9, 4.0), 0.7, (1.0, 8.0), 0.30, 4.5, 0.20),
    "arabic": Band((0.8, 4.0), 0.6, (1.0, 9.0), 0.30, 4.5, 0.20),
    "cjk": Band((0.3, 3.0), 0.25, (1.0, 4000.0), 0.75, 4.5, 0.20),
    "other": Band((0.2, 7.0), 0.2, (1.0, 4000.0), 0.95, 4.0, 0.30),
}
SCRIPTS = (("latin", re.compile("[A-Za-zÀ-ɏ]")), ("cyrillic", re.compile("[Ѐ-ӿ]")), ("greek", re.compile("[Ͱ-Ͽ]")), ("arabic", re.compile("[؀-ۿ]")), ("cjk", re.compile("[぀-ヿ㐀-鿿가-힯]")))


def script_of(text: str) -> str:
    """The script with the most letters."""
    counts = [(len(pattern.findall(text)), name) for name, pattern in SCRIPTS]
    most, name = max(counts, key=lambda x: x[0])
    return name if most else "other"


@cache
def _encoder(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(k) for k in range(model.vocab_size())])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, inside = Counter(windows), bytearray(len(words))
    for k, window in enumerate(windows):
        if counts[window] > 1:
            inside[k : k + 3] = b"\1\1\1"
    return sum(inside)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


@cache
def _byte_level(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_level", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Lengths(dict):
    """word -> its byte-level tokens; forgets when it has grown large."""

    def __init__(self, path: str):
        super().__init__()
        self.encode = _byte_level(path).encode_ordinary

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = n = len(self.encode(f" {word}"))
        return n


@cache
def _lengths(path: str) -> Lengths:
    return Lengths(path)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(texts: list[bytes], tokenizers: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the five base counts; tokens, byte tokens and byte-level tokens; entropy in bits; share of the most frequent token), a row per text."""
    model, of_byte = _encoder(os.path.join(tokenizers, MODEL))
    base, places, ids = [], {}, []
    for text in texts:
        words = text.split()
        ids.append(np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, len(words)))
        base.append((len(words), len(b"".join(words).decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), repeated_lines(text), repeated_words(words)))
    words = [w.decode("utf-8", "replace") for w in places]
    others = np.fromiter(map(_lengths(os.path.join(tokenizers, BYTE_MODEL)).__getitem__, words), np.int64, len(words))
    coded = model.encode(words, num_threads=1)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    flat = np.fromiter((t for c in coded for t in c), np.int64, int(sizes.sum()))
    first = np.concatenate(([0], np.cumsum(sizes)))
    counts, entropy, top = np.zeros((len(texts), 3), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
    for k, own in enumerate(ids):
        if not len(own):
            continue
        which, times = np.unique(own, return_counts=True)
        n = sizes[which]
        at = np.repeat(first[which] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        tokens, weight = flat[at], np.repeat(times, n)
        per = np.bincount(tokens, weight)
        per = per[per > 0]
        total = per.sum()
        counts[k] = total, weight[of_byte[tokens]].sum(), (others[which] * times).sum()
        share = per / max(total, 1)
        entropy[k], top[k] = -(share * np.log2(share)).sum(), share.max(initial=0)
    return np.array(base, np.int64).reshape(-1, 5), counts, entropy, top


def judged(texts: list[bytes], langs: list[str | None], tokenizers: str, bands: dict[str, Band]) -> list[pa.Array]:
    base, counts, entropy, top = measured(texts, tokenizers)
    failed = (base[:, 0] < MIN_WORDS) | (base[:, 4] > MAX_REPEATED * base[:, 0])
    keys = [lang if lang in bands and lang not in ("other", "latin", "cyrillic", "greek", "arabic", "cjk") else script_of(t.decode("utf-8", "replace")) for t, lang in zip(texts, langs, strict=True)]
    kept = [not failed[k] and bands[key].holds(base[k, 1], base[k, 0], counts[k, 0], counts[k, 2], counts[k, 1], entropy[k], top[k]) for k, key in enumerate(keys)]
    tokens = np.maximum(counts[:, 0], 1)
    return [*(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(kept, pa.bool_()), pa.array(counts[:, 0]), pa.array(base[:, 1] / tokens), pa.array(counts[:, 0] / np.maximum(base[:, 0], 1)), pa.array(counts[:, 1] / tokens), pa.array(entropy), pa.array(top), pa.array(base[:, 1] / np.maximum(counts[:, 2], 1)), pa.array(keys, pa.string())]


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, tokens_per_word double, byte_share double, entropy double, top_share double, chars_per_byte_level_token double, band string"


def _langs(batch: pa.RecordBatch, lang: str | None) -> list[str | None]:
    return batch.column(lang).cast(pa.string()).to_pylist() if lang in batch.schema.names else [None] * batch.num_rows


def measure_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", tokenizers: str = TOKENIZERS, bands: dict[str, Band] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the tokeniser's measures. No shuffle."""
    used = bands or BANDS
    wanted = [c for c in (id_col, text_col, lang_col) if c in docs.columns]
    fields = [x.strip().split(" ") for x in MEASURES.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), *judged(as_bytes(batch, text_col), _langs(batch, lang_col), tokenizers, used)], names=["doc_id", *(f[0] for f in fields)])

    return docs.select(*[f"`{c}`" for c in dict.fromkeys(wanted)]).mapInArrow(run, f"doc_id long, {MEASURES}")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", tokenizers: str = TOKENIZERS, bands: dict[str, Band] | None = None) -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    used = bands or BANDS
    named = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    text, lang = f"c{docs.columns.index(text_col)}", f"c{docs.columns.index(lang_col)}" if lang_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            yield batch.filter(judged(as_bytes(batch, text), _langs(batch, lang), tokenizers, used)[6])

    return named.mapInArrow(run, T.StructType(named.schema.fields)).toDF(*docs.columns)


def fit_bands(docs: DataFrame, labels: DataFrame, least_rows: int = 200, tokenizers: str = TOKENIZERS) -> dict[str, Band]:
    """Bands by language from labelled good rows whose crc32(doc_id as text) mod 4 is not 2: 95 % of the lower and 105 % (of the top share 125 %) of the upper 0.2 % quantile.

    Only languages with least_rows such rows that pass the base rule get one. A few quantiles a language reach the driver.
    """
    good = columns(labels, label_id="doc_id", quality="quality").filter("quality = 1").select("label_id").distinct()
    rows = docs.filter(crc_mod(F.col("doc_id"), 4) != 2).join(good, F.col("doc_id") == F.col("label_id"), "left_semi")
    low = lambda c: F.expr(f"percentile({c}, 0.002)") * 0.95
    high = lambda c, x: F.expr(f"percentile({c}, 0.998)") * x
    sums = measure_quality(rows, tokenizers=tokenizers).filter("not base_failed").join(columns(docs, lang_id="doc_id", lang="lang"), F.col("doc_id") == F.col("lang_id")).filter("lang is not null").groupBy("lang").agg(
        F.count("*").alias("n"), low("chars_per_token").alias("a"), low("chars_per_byte_level_token").alias("b"), high("tokens_per_word", 1.05).alias("c"), low("entropy").alias("d"), high("top_share", 1.25).alias("e")
    )
    return {r.lang: Band((round(r.a, 2), 6.5), round(r.b, 2), (1.0, round(r.c, 2)), 0.05, round(r.d, 2), round(r.e, 3)) for r in sums.filter(F.col("n") >= least_rows).collect()}


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_quality(table(spark, sf_dir, "documents"))
