"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary n-gram classifier weighs hashed byte
trigrams by how much likelier they are among the languages that have the bit set; a text's margin for
the bit is the mean weight of its trigrams. Decoding adds each codeword's losses over the bits, weighted
by how well a bit's two sides are told apart, and takes the codeword with the least. The classifiers are
closed forms over trigram counts of all training rows.

Defined cases: a null text or one without letters is ``und`` with score 0, as is every text where no
training row exists; with a single language all others texts get that one; a null doc_id counts as an
empty text in the split; ties between languages go to the first in sorted order; repeated rows count and are judged
each; an empty table gives an empty result; columns beside id, text and language play no part; a text of any length is
judged whole. Of more than LANGUAGES values of the language column those with most trigrams are learned.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, columns, crc_mod, sliced, table

BUCKETS_LOG2 = 15
BUCKETS = 1 << BUCKETS_LOG2
#: Languages learned at most, and languages whose counts a task holds before it gives them out.
LANGUAGES, HELD = 1000, 64
SMOOTHING, SHARPNESS, AMBIGUOUS_GAP = 1e-5, 12.0, 0.25
#: ASCII other than letters becomes a space.
LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
LETTER = re.compile(r"[^\W\d_]")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, runner_up string, ambiguous boolean"


def hashed(text: str) -> np.ndarray:
    """The buckets of the text's byte trigrams, in lower case, words set off by spaces."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(LETTERS) + b" ", np.uint8).astype(np.uint32)
    return (((raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS_LOG2)


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A row of -1 and 1 for each class: every split in two up to five classes, else the best of random codes."""
    if classes <= 5:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=max(0, classes - 1)) if -1 in rest]
        return np.array(splits or [(1,)], np.int8).T
    length = int(np.ceil(10 * np.log2(classes)))
    rng, best, least = np.random.default_rng(seed), None, -1
    for _ in range(40):
        code = rng.choice(np.array([-1, 1], np.int8), (classes, length))
        code = code[:, np.abs(code.sum(axis=0)) < classes]
        apart = (code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2
        if (d := int(apart[np.triu_indices(classes, 1)].min())) > least:
            best, least = code, d
    return best


class Codebook:
    """langs, codewords (languages x bits), weights (buckets x bits) and the bits' reliabilities."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(max(1, len(langs)))
        if not langs:
            return
        share = (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float64)
        bits, weights, worth = self.code.shape[1], [], []
        for j in range(bits):
            yes, no = self.code[:, j] == 1, self.code[:, j] == -1
            p = share[yes].mean(axis=0) + SMOOTHING
            q = (share[no].mean(axis=0) if no.any() else np.full(counts.shape[1], 1 / counts.shape[1])) + SMOOTHING
            w = np.log(p / q)
            weights.append(w)
            worth.append(((p - q) * w).sum())
        self.weights = np.stack(weights, axis=1).astype(np.float32)
        self.worth = np.array(worth) / max(sum(worth), 1e-12)

    def decode(self, text: str | None) -> tuple[str, float, str | None, bool]:
        """(language, score, runner-up, ambiguous)"""
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, None, True
        at = hashed(text)
        sums = np.bincount(at, minlength=BUCKETS) @ self.weights if len(at) > BUCKETS else self.weights[at].sum(axis=0)
        margin = sums / len(at)
        loss = np.log1p(np.exp(-SHARPNESS * np.clip(self.code * margin, -50 / SHARPNESS, 50 / SHARPNESS))) @ self.worth
        near = np.exp(loss.min() - loss)
        share = near / near.sum()
        order = np.argsort(loss, kind="stable")
        gap = share[order[0]] - (share[order[1]] if len(order) > 1 else 0)
        return self.langs[order[0]], float(share[order[0]]), self.langs[order[1]] if len(order) > 1 else None, bool(gap < AMBIGUOUS_GAP)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in found.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])
        found.clear()

    for batch in sliced(batches, "text"):
        waiting = defaultdict(list)
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            waiting[lang].append(hashed(text))
        for lang, own in waiting.items():
            if lang not in found and len(found) >= HELD:
                yield from flush()
            found.setdefault(lang, np.zeros(BUCKETS, np.int64))[:] += np.bincount(np.concatenate(own), minlength=BUCKETS)
    yield from flush()


def learn(rows: DataFrame, languages: int = LANGUAGES) -> Codebook:
    """rows: text, lang. At most ``languages`` x BUCKETS sums reach the driver, whatever the input."""
    sums = checkpointed(rows.filter("text is not null and lang is not null").select("text", "lang").mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    kept = sums.groupBy("lang").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "lang").limit(languages)
    counts = sums.join(F.broadcast(kept.select("lang")), "lang").toArrow()
    names = counts.column("lang").to_pylist()
    langs = sorted(set(names))
    dense = np.zeros((len(langs), BUCKETS))
    place = {x: k for k, x in enumerate(langs)}
    dense[[place[x] for x in names], counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    return Codebook(langs, dense)


def predict(rows: DataFrame, book: Codebook) -> DataFrame:
    """rows: doc_id, text, held_out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            out = list(zip(*map(book.decode, batch.column("text").to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), *(pa.array(c, t) for c, t in zip(out, (pa.string(), pa.float64(), pa.string(), pa.bool_()), strict=True))], names=["doc_id", "held_out", "lang_pred", "score", "runner_up", "ambiguous"])

    return rows.mapInArrow(run, SCHEMA)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held: int = 2) -> DataFrame:
    rows = columns(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("held_out", crc_mod(F.col("doc_id"), modulus) == held)
    book = learn(rows.filter("not held_out"))
    return predict(rows.select("doc_id", "text", "held_out"), book)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
