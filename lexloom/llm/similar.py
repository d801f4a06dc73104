"""Near-dedup by SimHash, then by an exact join by prefixes: pigeonhole blocks, Hamming bounds, verified sets, components.

A text is the set of its shingles of five words (fewer words are one shingle), each as its 64-bit hash. Its SimHash
fingerprint has a bit if over half of these have it. Fingerprints two bits apart at most meet in blocks, as in simhash.py; sets
whose fingerprints do are verified by their similarity, and the links that hold are closed to classes. That brings together
close copies, also where they crowd, but not all pairs at the similarity: most of those lie further apart than two bits, and
a distance that took in all would leave blocks too small to tell texts apart. So sets of different classes go on to an exact join.

In any one order of all shingles, two sets of similarity s share one of the first n - ceil(s * n) + 1 shingles of
each; sets that share such a one, and whose sizes and places allow s, meet and are verified on the whole
sets. So every pair at s or more is found, none below, whatever the order. It is by hash, but shingles that about
HOT sets or more hold, going by a sample, come last, the more common the later, so that a passage that many texts
quote brings few together. Sets are worked out from the texts again where they are needed, which saves disk.

Each set also has a fingerprint of SKETCH * 64 bits: the parities of how many of its shingles fall on a bit. Two
fingerprints differ in at most as many bits as the sets in shingles, so pairs further apart than s allows are left
out within the join, before they become rows, and no pair at s or more is.

Shingles that still lead more than HOT sets belong to large groups of near copies. There the LEADERS sets with
the fewest rarer shingles are held against all others first; then only sets of different classes meet, those
of a shingle's largest class on one side only.

Links are closed to classes on the driver up to DRIVER_LINKS of them, by rounds of joins as in simhash.py beyond.

Defined cases: words are split at ASCII white space, A-Z count as a-z; texts without words, null too, have the
empty set and are alike; equal sets are one from the start; repeated rows are one set; an empty table has no
classes; columns beside the id and text play no part; a text of any length is one set, held in one task at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, checkpointed, columns, sliced, with_values
from .simhash import CHUNK, LAST, LOWER, SEED, components, near_pairs

SHINGLE, SIMILARITY, HOT, LEADERS, SKETCH = 5, 0.8, 64, 3, 4
#: Sets meet by the upper bits of a shingle's hash. One set in SAMPLE tells which shingles are common; at most so many are told apart.
TOKEN_SHIFT, SAMPLE, MOST_COMMON = 24, 16, 4_000_000
#: Places of sets up to which they are broadcast.
BROADCAST_ROWS = 2_000_000
#: Links up to which the driver closes them, 16 bytes each. Rounds of joins over so few only make tasks, files and compiled code.
DRIVER_LINKS = 250_000
#: Against rounding: prefixes are rather too long, and bounds too wide, than the other way round.
SLACK = 1e-9


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, in order."""
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    runs = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in runs], np.uint64).view(np.int64))


def _lists(each: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, each)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(each) if each else np.zeros(0, np.int64)))


def print_of(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).astype(np.int64))


def texts_of(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text -> doc_id (LAST for null), text_hash, text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def sketch_of(own: np.ndarray) -> np.ndarray:
    """SKETCH longs: the parity of the shingles on each bit."""
    bits = SKETCH * 64
    return np.packbits((np.bincount(own & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def simhash_of(own: np.ndarray) -> int:
    """64 bits: whether over half of the shingles have each."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(own), CHUNK):
        total += np.unpackbits(own[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(own)).view(np.int64)[0])


BITS = [f"s{k}" for k in range(SKETCH)]


def prints(texts: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, fp (a hash of the set), n (its size), its SimHash and the fingerprint of parities."""
    names = ["doc_id", "text_hash", "fp", "n", "simhash", *BITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = [shingles(t, width) for t in as_bytes(batch, "text")]
            sketches = np.stack([sketch_of(s) for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(list(map(print_of, sets)), pa.int64()), pa.array(list(map(len, sets)), pa.int32()), pa.array(list(map(simhash_of, sets)), pa.int64()), *(pa.array(sketches[:, k]) for k in range(SKETCH))], names=names)

    return texts.mapInArrow(run, "doc_id long, text_hash long, fp long, n int, simhash long, " + ", ".join(f"{b} long" for b in BITS))


def common_shingles(texts: DataFrame, width: int, hot: int) -> np.ndarray:
    """Tokens that about ``hot`` sets or more hold, the rarest first; at most MOST_COMMON, the most common. They only set the order, so a sample of the sets will do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in sliced(batches, "text"):
            for text in as_bytes(batch, "text"):
                own = shingles(text, width)
                fp = print_of(own)
                if fp % SAMPLE == 0 and fp not in seen:
                    seen.add(fp)
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(own >> TOKEN_SHIFT))], names=["token"])

    held = texts.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("held")).filter(F.col("held") > max(1, hot // SAMPLE))
    got = held.orderBy(F.desc("held"), "token").limit(MOST_COMMON).toArrow()
    return got.column("token").to_numpy()[::-1].copy()


def prefixes(texts: DataFrame, common: np.ndarray, width: int, similarity: float) -> DataFrame:
    """token, fp, place: each set's prefix, common shingles last. A set comes once for a task at least."""
    by_token = np.argsort(common)
    shared = texts.sparkSession.sparkContext.broadcast((common[by_token], by_token + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, rank), seen = shared.value, set()
        for batch in sliced(batches, "text"):
            parts = []
            for text in as_bytes(batch, "text"):
                own = shingles(text, width)
                fp = print_of(own)
                if not len(own) or fp in seen:
                    continue
                seen.add(fp)
                tokens = own >> TOKEN_SHIFT
                late = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    late = np.where(known[at] == tokens, rank[at], 0)
                first = tokens[np.lexsort((own, late))[: len(own) - math.ceil(similarity * len(own) - SLACK) + 1]]
                parts.append((first, np.full(len(first), fp), np.arange(len(first), dtype=np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["token", "fp", "place"])

    return texts.mapInArrow(run, "token long, fp long, place int")


def sets_of(texts: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """places: fp, doc_id, text_hash of one text for each set -> fp, set; worked out from the texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in sliced(batches, "text"):
            for fp, text in zip(batch.column("fp").to_pylist(), as_bytes(batch, "text"), strict=True):
                if fp not in seen:
                    seen.add(fp)
                    yield pa.RecordBatch.from_arrays([pa.array([fp], pa.int64()), _lists([shingles(text, width)])], names=["fp", "set"])

    places = checkpointed(places)
    few = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places
    return texts.join(few, ["doc_id", "text_hash"]).select("fp", "text").mapInArrow(run, "fp long, set array<long>")


def side(met: DataFrame, name: str, *more: str) -> DataFrame:
    return met.select("token", *[F.col(c).alias(f"{c}_{name}") for c in ("fp", "n", "place", *BITS, *more)])


def possible(left: DataFrame, right: DataFrame, similarity: float, *also: Column) -> DataFrame:
    """left, right: sides a and b -> pairs a < b, distinct, which meet and which size, places and fingerprints allow. These are conditions of the join."""
    total = F.col("n_a") + F.col("n_b")
    apart = sum((F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in BITS), F.lit(0))
    rest = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    allowed = [F.col("fp_a") != F.col("fp_b"), rest >= total * (similarity / (1 + similarity)) - SLACK, apart <= total * ((1 - similarity) / (1 + similarity)) + SLACK, *also]
    met = left.withColumnRenamed("token", "token_a").join(right, reduce(Column.__and__, allowed, F.col("token_a") == F.col("token")))
    return met.select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, places: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    pairs = checkpointed(pairs)
    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    sets = sets_of(texts, places.join(wanted, "fp", "left_semi"), width)
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("fp").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return checkpointed(both.filter(common / (F.size("sa") + F.size("sb") - common) >= similarity).select("a", "b").distinct())


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes -> the nodes, and the least node that each reaches. Roots hang on lesser ones until no link joins two."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while not np.array_equal(root, jumped := root[root]):
            root = jumped


def closed(links: DataFrame, most: int = DRIVER_LINKS) -> DataFrame:
    """links (a, b) -> node, root, as components() has them, which takes over where the links are more than ``most``."""
    if links.count() > most:
        return components(links)
    few = links.toArrow()
    if not few.num_rows:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    nodes, roots = least_reached(*(few.column(c).to_numpy() for c in ("a", "b")))
    return links.sparkSession.createDataFrame(pa.table({"node": nodes, "root": roots}), "node long, root long")


def simhash_links(sets: DataFrame, texts: DataFrame, places: DataFrame, width: int, similarity: float) -> DataFrame:
    """sets: fp, simhash -> links (a, b) between alike sets whose SimHash fingerprints meet. Of the sets of one fingerprint the least stands for the others."""
    firsts = checkpointed(sets.groupBy("simhash").agg(F.min("fp").alias("first")))
    same = with_values(sets.select("fp", "simhash"), firsts, "simhash").filter("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    met = near_pairs(firsts.select(F.col("simhash").alias("fp")))
    near = met.join(firsts.toDF("a", "x"), "a").join(firsts.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return verified(same.union(near).distinct(), texts, places, width, similarity)


def links(texts: DataFrame, rows: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """texts of texts_of(), rows of prints() -> links (a, b) between fp that connect the same sets as all pairs at the similarity or more would."""
    sets = checkpointed(rows.filter("n > 0").groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"), *[F.any_value(c).alias(c) for c in ("n", "simhash", *BITS)]))
    places = sets.select("fp", "x.doc_id", "x.text_hash")
    dealt = simhash_links(sets, texts, places, width, similarity)
    merged = closed(dealt).withColumnRenamed("node", "fp")
    apart = F.coalesce(F.col("root_a") != F.col("root_b"), F.lit(True))
    tokens = prefixes(texts, common_shingles(texts, width, hot), width, similarity)
    own = Window.partitionBy("token")
    shared = tokens.withColumns({"x": F.min("fp").over(own), "y": F.max("fp").over(own)}).filter("x <> y")
    met = checkpointed(shared.select("token", "fp", "place").distinct())
    crowded = checkpointed(met.groupBy("token").count().filter(F.col("count") > hot).select("token"))
    full = met.join(sets.drop("x", "simhash").join(merged, "fp", "left"), "fp")
    few = full.join(crowded, "token", "left_anti")
    cold = possible(side(few, "a", "root"), side(few, "b", "root"), similarity, F.col("fp_a") < F.col("fp_b"), apart)
    if crowded.isEmpty():
        return dealt.union(verified(cold, texts, places, width, similarity))
    many = checkpointed(full.join(crowded, "token", "left_semi"))
    lead = many.withColumn("nth", F.row_number().over(own.orderBy("place", "fp"))).filter(F.col("nth") <= LEADERS)
    found = dealt.union(verified(cold.union(possible(side(lead, "a", "root"), side(many, "b", "root"), similarity, apart)), texts, places, width, similarity))
    roots = closed(found).withColumnRenamed("node", "fp")
    classed = checkpointed(many.drop("root").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    largest = classed.groupBy("token", "root").count().groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("top"))
    rest = classed.join(largest, "token").filter("root <> top")
    open_pairs = possible(side(rest, "a", "root"), side(classed, "b", "root"), similarity, F.col("root_a") != F.col("root_b"))
    return found.union(verified(open_pairs, texts, places, width, similarity))


def classes(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """docs: doc_id, text -> doc_id (LAST for null), text_hash, root, for simhash.keep_one()."""
    texts = texts_of(columns(docs, doc_id="doc_id", text="text"))
    rows = checkpointed(prints(texts, width))
    found = closed(links(texts, rows, width, similarity, hot)).withColumnRenamed("node", "fp")
    return with_values(rows.select("doc_id", "text_hash", "fp"), found, "fp").select("doc_id", "text_hash", F.coalesce("root", "fp").alias("root"))
