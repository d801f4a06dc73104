"""SimHash near-dedup: fingerprints over three-word shingles, pigeonhole blocks, verified distances, components.

Distinct fingerprints are cut into four blocks of 16 bits. Two that differ in two bits at most agree on at
least two blocks, so they meet under one of six keys of 32 bits; pairs that meet are verified. A key that
more than HOT fingerprints share isn't expanded into pairs: its members instead meet under themselves
and their 64 one-bit neighbours. Two fingerprints share such a point if and only if they differ in two bits at
most, and at most 65 share one, so linking each to the least of its point is exact and makes no pairs.
Links between fingerprints are closed by alternating large-star and small-star rounds.

Defined cases: words are split at ASCII white space; a null or wordless text has fingerprint zero, linked
like any other; fewer than three words are one shingle; rows with one doc_id are fingerprinted each, and
a null doc_id counts as the largest (component_id is null if all of a component's are); columns beside
the id and text play no part; an empty table gives an empty result; a text of any length is fingerprinted whole, CHUNK
shingles at a time. Fingerprints that very many rows share are met by a bounded broadcast. keep_one() goes by texts: rows that share an id, or have none, are told apart.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, checkpointed, columns, sliced, table, with_values

SHINGLE, SEED, DISTANCE, BLOCK_BITS, HOT = 3, 42, 2, 16, 64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are spread out at a time.
CHUNK = 1 << 17
LAST = (1 << 63) - 1


def fingerprint(text: bytes) -> int:
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return 0
    runs = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    hashed, total, n = iter(runs), np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_intdigest
    while own := [digest(s, SEED) for s in itertools.islice(hashed, CHUNK)]:
        total += np.unpackbits(np.array(own, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(own)
    return int(np.packbits(2 * total > n).view(">u8")[0])


def _prints(texts: list[bytes]) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp (the 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), _prints(as_bytes(batch, "text"))], names=["doc_id", "text_hash", "fp"])

    return columns(docs, doc_id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def near_pairs(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """prints: distinct fp -> links (a, b) that connect the same fingerprints as all pairs within DISTANCE would."""
    blocks = [F.shiftrightunsigned("fp", k * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1) for k in range(64 // BLOCK_BITS)]
    keys = [F.struct(F.lit(n).cast("byte").alias("kind"), F.shiftleft(blocks[i], BLOCK_BITS).bitwiseOR(blocks[j]).alias("key")) for n, (i, j) in enumerate(itertools.combinations(range(len(blocks)), len(blocks) - DISTANCE))]
    met = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", F.shiftleft(F.col("k.kind").cast("long"), 2 * BLOCK_BITS).bitwiseOR(F.col("k.key")).alias("key"))
    sizes = met.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = checkpointed(with_values(met, sizes, "key").filter("n > 1"))
    few, many = crowded.filter(F.col("n") <= hot), crowded.filter(F.col("n") > hot).select("fp").distinct()
    other = few.select("key", F.col("fp").alias("b"))
    cold = few.select("key", F.col("fp").alias("a")).join(other, "key").filter("a < b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(64)])
    points = many.select("fp", F.explode(flips).alias("point"))
    least = F.min("fp").over(Window.partitionBy("point"))
    stars = points.select(least.alias("a"), F.col("fp").alias("b")).filter("a < b")
    return cold.unionByName(stars).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b) -> node, root: the least node it reaches. Nodes without links are left out.

    Large-star and small-star rounds: each keeps the components and shortens paths; it ends when every
    node hangs on its root. A round's tables are written to the checkpoint folder. A node that very many
    links share is met by a bounded broadcast.
    """
    edges = checkpointed(links.filter("a <> b"))
    before, total = None, edges.count()
    for _ in range(most_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = with_values(both, least, "u", total=2 * total).filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = with_values(down, low, "u", total=total).select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        edges = checkpointed(small)
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before, total = after, after[0]
    else:
        raise RuntimeError(f"components are still open after {most_rounds} rounds")
    roots = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return roots.union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def roots_of(prints: DataFrame) -> DataFrame:
    """prints: distinct fp, first -> fp, component: the least ``first`` of the fingerprints it reaches. Only linked ones."""
    found = components(near_pairs(prints.select("fp")))
    named = found.join(prints, found["node"] == prints["fp"]).select("fp", "root", "first")
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    return named.join(least, "root").select("fp", "component")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (LAST for null), fp, component."""
    rows = checkpointed(fingerprints(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "fp"))
    prints = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    classes = prints.join(roots_of(prints), "fp", "left").select("fp", F.coalesce("component", "first").alias("component"))
    return with_values(rows, classes, "fp")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id, one row per document."""
    null = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return linked(docs, id_col, text_col).select(null("doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), null("component").alias("component_id"))


def classes(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text -> doc_id (LAST for null), text_hash, root: the fingerprint that stands for all that the row's own one reaches."""
    rows = checkpointed(fingerprints(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST))))
    found = components(near_pairs(rows.select("fp").distinct())).withColumnRenamed("node", "fp")
    return with_values(rows.select("doc_id", "text_hash", "fp"), found, "fp").select("doc_id", "text_hash", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: Callable[[DataFrame], DataFrame] = classes) -> DataFrame:
    """The rows of docs, with all columns, but one for each class: that with the least doc_id, then the least hash of its text, then the least other values.

    Rows are told apart by their own class, so different texts stay even where ids are null or shared.
    """
    least = classes(columns(docs, doc_id=id_col, text=text_col)).groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"))
    kept = least.select(F.col("x.doc_id").alias("d"), F.col("x.text_hash").alias("t"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(F.col(f"`{text_col}`")).alias("t"), whole.alias("row")).join(kept, ["d", "t"], "left_semi")
    order = F.struct(*[F.col(f"row.`{f.name}`") if _orderable(f.dataType) else F.to_json(F.struct(f"row.`{f.name}`")) for f in docs.schema.fields])
    return rows.groupBy("d", "t").agg(F.min_by("row", order).alias("row")).select("row.*")


def _orderable(kind: T.DataType) -> bool:
    """Whether Spark can sort by it: no map or variant within."""
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return _orderable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
