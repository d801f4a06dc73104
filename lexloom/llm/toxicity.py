"""Toxicity by two class-conditional Kneser-Ney models with shared back-off counts.

Both classes count words by the different words before them, and pairs of words by the different words
before these, so that copies of a text add nothing. A class takes an absolute discount from its counts,
estimated from its counts of counts as n1 / (n1 + 2 n2), and hands WORD_BACK (for pairs PAIR_BACK) of its
mass to counts that both classes share: words to the shared words, pairs to the class's own words. As the
share is the same for both, what neither class knows has a ratio of 0, and what one class saw once or
twice weighs little. What only one context was seen for, in both classes together, is left to the back-off.

Each word has the log of its toxic less its ordinary likelihood. A text's ratio is the largest mean over
PASSAGE words in a row, that is a length-normalised ratio of passages; that of the whole text is given as
well, but hides a few toxic words in a long text (README has figures). A logistic fit makes it a score.

All counts are exact sums over all training rows in distributed tables, keyed by 64-bit hashes of words; of
a pair the first word enters by 31 bits and the word before it by 32. Up to BROADCAST_ENTRIES entries the model is
sent to the texts; beyond, the texts' words meet it in a join. Four fifths of the labelled training rows, by
a hash of doc_id, make the counts, the others calibrate: a histogram of their ratios over all rows.

Defined cases: a null or wordless text gets the calibrated score of ratio 0; several labels of one
doc_id count as toxic if one is; rows without a label train nothing; without training rows of both
classes every score is 0; repeated rows are scored each; an empty table gives an empty result; columns beside
those named play no part, in labels too; a text of any length is scored whole; equal ratios get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, columns, crc_mod, sliced, stored, table
from .licenses import WORDS

THRESHOLD, BINS, RANGE = 0.7, 16_000, 4.0
#: Passage length and shares of the back-off, chosen by three-fold cross-validation within the rows that may train (crc32 mod 3 not 1).
PASSAGE, WORD_BACK, PAIR_BACK = 3, 0.97, 0.99
#: Codes that a task gathers before it takes out repeats; labelled ids, and entries of the model (16 bytes each), up to which they are broadcast.
GATHERED = 2_000_000
BROADCAST_ROWS = 4_000_000
BROADCAST_ENTRIES = 8_000_000
ODD, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Hashes(dict):
    """word -> its 64-bit hash; forgets when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[word] = at = xxhash.xxh64_intdigest(word)
        return at


def hashed(text: bytes, hashes: Hashes) -> np.ndarray:
    """The words' hashes, after two zeros that stand before the first."""
    words = text.translate(WORDS).split()
    own = np.zeros(len(words) + 2, np.uint64)
    own[2:] = [hashes[w] for w in words]
    return own


def left_of(own: np.ndarray) -> np.ndarray:
    """31 bits of the word before each."""
    return own[1:-1] * ODD >> np.uint64(33)


def pair_key(words: np.ndarray, left: np.ndarray) -> np.ndarray:
    return words * ODD ^ (left + np.uint64(1)) * OTHER


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, toxic -> distinct w and code: 31 bits of the word before, 32 of the one before that, 1 of toxic."""
    hashes, held, size = Hashes(), [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        words, codes = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((codes, words))
        words, codes = words[order], codes[order]
        new = np.concatenate(([True], (words[1:] != words[:-1]) | (codes[1:] != codes[:-1])))
        words, codes = words[new].view(np.int64), codes[new].view(np.int64)
        for k in range(0, len(words), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[k : k + 200_000]), pa.array(codes[k : k + 200_000])], names=["w", "code"])
        held.clear()

    for batch in sliced(batches, "text"):
        for text, toxic in zip(as_bytes(batch, "text"), batch.column("toxic").to_pylist(), strict=True):
            own = hashed(text, hashes)
            if len(own) > 2:
                held.append((own[2:], left_of(own) << np.uint64(33) | own[:-2] >> np.uint64(32) << np.uint64(1) | np.uint64(toxic > 0)))
                size += len(own)
        if size > GATHERED:
            yield from flush()
            size = 0
    yield from flush()


#: Kinds of counts: of a word, of a pair, and how many pairs were counted once, twice and in sum.
WORD, PAIR, COUNTS = 0, 1, 2


def counts_of(rows: DataFrame) -> DataFrame:
    """rows: text, toxic -> kind, w, u, n0, n1.

    A pair (31 bits u of the first word, w) counts before how many different words it was seen, in the
    ordinary and in the toxic rows; a word after how many. Pairs and words counted once in all are left out, but COUNTS (w null)
    has for u = 1 and 2 how many pairs a class counted so often, and for u = 0 the sum of its counts.
    """
    codes = rows.select("text", "toxic").mapInArrow(_coded, "w long, code long").withColumn("u", F.shiftrightunsigned("code", 33))
    toxic = F.col("code").bitwiseAND(F.lit(1))
    pairs = codes.repartition("w", "u").dropDuplicates(["w", "u", "code"]).groupBy("w", "u").agg(F.sum(1 - toxic).alias("n0"), F.sum(toxic).alias("n1"))
    row = lambda kind, w, u, n0, n1: F.struct(F.lit(kind).alias("kind"), w.alias("w"), u.alias("u"), n0.cast("long").alias("n0"), n1.cast("long").alias("n1"))
    n, none = (F.col("n0"), F.col("n1")), F.lit(None).cast("long")
    made = [row(WORD, F.col("w"), none, *[x > 0 for x in n]), row(COUNTS, none, F.lit(0).cast("long"), *n), *[row(COUNTS, none, F.lit(k).cast("long"), *[x == k for x in n]) for k in (1, 2)]]
    every = pairs.select(F.explode(F.when(n[0] + n[1] > 1, F.array(*made, row(PAIR, F.col("w"), F.col("u"), *n))).otherwise(F.array(*made))).alias("x")).select("x.*")
    return every.groupBy("kind", "w", "u").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def discount(once: float, twice: float) -> float:
    return once / (once + 2 * twice) if once else 0.5


def lifts(entries: DataFrame, totals: list[float], discounts: list[float]) -> list:
    """By class: how much likelier an entry is in the class, after the discount, than in both together."""
    both = F.col("n0") + F.col("n1")
    return [(F.greatest(F.col(f"n{c}") - F.lit(discounts[c]), F.lit(0.0)) / max(totals[c], 1) / (both / max(sum(totals), 1))).cast("float").alias(f"l{c}") for c in (0, 1)]


class Model:
    """entries: kind, w, u, l0, l1. Sent out or joined, as its size allows."""

    slope, offset = 1.0, 0.0

    def __init__(self, entries: DataFrame, most: int):
        self.entries, self.shared = entries, None
        if entries.count() <= most:
            got = entries.toArrow()
            kind, w, u = (got.column(c).to_numpy() for c in ("kind", "w", "u"))
            w, u = w.view(np.uint64), np.nan_to_num(u).astype(np.uint64)
            l0, l1 = got.column("l0").to_numpy(), got.column("l1").to_numpy()
            parts = []
            for keys, own in ((w, kind == WORD), (pair_key(w, u), kind == PAIR)):
                order = np.argsort(keys[own])
                parts += [keys[own][order], l0[own][order], l1[own][order]]
            self.shared = entries.sparkSession.sparkContext.broadcast(parts)


def learn(rows: DataFrame, most: int = BROADCAST_ENTRIES) -> Model | None:
    """rows: text, toxic. A few sums reach the driver, and the model if it has at most ``most`` entries."""
    counts = stored(counts_of(rows), "counts")
    pairs = {r.u: (r.n0, r.n1) for r in counts.filter(F.col("kind") == COUNTS).collect()}
    words = counts.filter(F.col("kind") == WORD)
    n = words.agg(*[f(F.col(f"n{c}")).alias(f"{k}{c}") for c in (0, 1) for k, f in (("sum", F.sum), ("once", lambda x: F.sum((x == 1).cast("long"))), ("twice", lambda x: F.sum((x == 2).cast("long"))))]).first()
    if not n.sum0 or not n.sum1:
        return None
    of_words = lifts(words, [n.sum0, n.sum1], [discount(n.once0, n.twice0), discount(n.once1, n.twice1)])
    of_pairs = lifts(counts, list(pairs[0]), [discount(pairs[1][c], pairs[2][c]) for c in (0, 1)])
    kept = words.filter("n0 + n1 > 1").select("kind", "w", "u", *of_words)
    return Model(stored(kept.union(counts.filter(F.col("kind") == PAIR).select("kind", "w", "u", *of_pairs)), "model"), most)


def likelier(word: tuple, pair: tuple) -> np.ndarray:
    """Toxic less ordinary log-likelihood of each word, up to what both share, from the lifts of words and of pairs."""
    logs = [np.log(PAIR_BACK * (WORD_BACK + (1 - WORD_BACK) * w) + (1 - PAIR_BACK) * p) for w, p in zip(word, pair, strict=True)]
    return logs[1] - logs[0]


def passage_ratio(each: np.ndarray) -> tuple[float, float]:
    """(the largest mean over PASSAGE words in a row, the mean over all)"""
    if len(each) <= PASSAGE:
        mean = float(each.mean()) if len(each) else 0.0
        return mean, mean
    sums = np.concatenate(([0], np.cumsum(each)))
    return float((sums[PASSAGE:] - sums[:-PASSAGE]).max() / PASSAGE), float(sums[-1] / len(each))


def ratios(rows: DataFrame, model: Model, *also: str) -> DataFrame:
    """The columns named, ratio and text_ratio."""
    return sent_ratios(rows, model, *also) if model.shared else joined_ratios(rows, model, *also)


def sent_ratios(rows: DataFrame, model: Model, *also: str) -> DataFrame:
    kinds, shared = dict(rows.dtypes), model.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (words, w0, w1, pairs, p0, p1) = Hashes(), shared.value

        def found(keys: np.ndarray, sought: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
            if not len(keys):
                return [np.zeros(len(sought)) for _ in values]
            at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
            hit = keys[at] == sought
            return [np.where(hit, v[at].astype(np.float64), 0.0) for v in values]

        def of(text: bytes) -> tuple[float, float]:
            own = hashed(text, hashes)
            return passage_ratio(likelier(found(words, own[2:], w0, w1), found(pairs, pair_key(own[2:], left_of(own)), p0, p1)))

        for batch in sliced(batches, "text"):
            out = np.array([of(t) for t in as_bytes(batch, "text")]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in also), pa.array(out[:, 0]), pa.array(out[:, 1])], names=[*also, "ratio", "text_ratio"])

    return rows.select("text", *also).mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in also), "ratio double, text_ratio double"]))


def joined_ratios(rows: DataFrame, model: Model, *also: str) -> DataFrame:
    """Distinct texts' words meet the model in joins by word and by pair; what is found of a text is put in order again."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in sliced(batches, "text", 400_000):
            for key, text in zip(batch.column("key").to_pylist(), as_bytes(batch, "text"), strict=True):
                own = hashed(text, hashes)
                n = len(own) - 2
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.full(n, n)), pa.array(np.arange(n)), pa.array(own[2:].view(np.int64)), pa.array(left_of(own).astype(np.int64))], names=["key", "n", "place", "w", "u"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, met in zip(batch.column("n").to_pylist(), batch.column("met").to_pylist(), strict=True):
                lift = np.zeros((2, 2, n))
                for x in met:
                    lift[x["kind"], :, x["place"]] = x["l0"], x["l1"]
                out.append(passage_ratio(likelier(lift[0], lift[1])))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([a for a, _ in out], pa.float64()), pa.array([b for _, b in out], pa.float64())], names=["key", "ratio", "text_ratio"])

    keyed = rows.select("text", *also).withColumn("key", F.xxhash64("text"))
    places = keyed.groupBy("key").agg(F.any_value("text").alias("text")).select("key", "text").mapInArrow(placed, "key long, n long, place long, w long, u long")
    words, pairs = (model.entries.filter(F.col("kind") == k) for k in (WORD, PAIR))
    met = places.join(words.drop("u"), "w").union(places.join(pairs, ["w", "u"]).select("w", "key", "n", "place", places["u"], "kind", "l0", "l1"))
    own = met.groupBy("key").agg(F.any_value("n").alias("n"), F.collect_list(F.struct("kind", "place", "l0", "l1")).alias("met"))
    found = own.select("key", "n", "met").mapInArrow(scored, "key long, ratio double, text_ratio double")
    return keyed.drop("text").join(found, "key", "left").select(*also, F.coalesce("ratio", F.lit(0.0)).alias("ratio"), F.coalesce("text_ratio", F.lit(0.0)).alias("text_ratio"))


def calibrate(model: Model, rows: DataFrame) -> None:
    """A logistic fit, as if both classes were as frequent, over the histogram of all calibration rows: at most 2 * BINS sums reach the driver."""
    at = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("ratio") + RANGE) / (2 * RANGE) * BINS))).cast("int")
    got = ratios(rows, model, "toxic").groupBy(at.alias("at"), (F.col("toxic") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).toArrow()
    x, y, n = (got.column(0).to_numpy() + 0.5) / BINS * 2 * RANGE - RANGE, got.column(1).to_numpy(), got.column(2).to_numpy()
    if len(set(y.tolist())) < 2:
        return
    order = np.lexsort((y, x))
    x, y, n = x[order], y[order], n[order]
    n = n * np.where(y == 1, n[y == 0].sum() / n[y == 1].sum(), 1.0)
    middle, spread = np.average(x, weights=n), max(1e-6, np.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n)))
    z, w = np.stack([(x - middle) / spread, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(2), z.T @ (n * (y - p)) - 0.05 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.offset = float(w[0] / spread), float(w[1] - w[0] * middle / spread)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 3, held: int = 1, broadcast_rows: int = BROADCAST_ROWS, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """doc_id, held_out, score, predicted, ratio, text_ratio. Up to broadcast_rows labelled ids (12 bytes each) are sent to the texts; beyond, both are shuffled."""
    rows = columns(docs, doc_id=id_col, text=text_col).withColumn("held_out", crc_mod(F.col("doc_id"), modulus) == held)
    known = columns(labels, doc_id=id_col, toxic=label_col).filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if known.limit(broadcast_rows + 1).count() <= broadcast_rows:
        known = F.broadcast(known)
    marked = rows.filter("not held_out").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(5))).join(known, "doc_id")
    model = learn(marked.filter("part > 0").select("text", "toxic"), broadcast_entries)
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0.0).alias("ratio"), F.lit(0.0).alias("text_ratio"))
    calibrate(model, marked.filter("part = 0").select("text", "toxic"))
    x = F.col("ratio") * model.slope + model.offset
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), x))))
    return ratios(rows, model, "doc_id", "held_out").select("doc_id", "held_out", score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), "ratio", "text_ratio")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
