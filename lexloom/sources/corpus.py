"""Reading corpora into samples and writing them. Paths are read by Spark, so any store that it knows will do.

samples: pos, text, instruction, response, document_type, jurisdiction, source, metadata (map to JSON texts).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import fixed

TEXT, CONTEXT = ("text", "input", "context", "document", "content", "body"), ("input", "context", "document", "content", "body", "text")
INSTRUCTION, RESPONSE = ("instruction", "prompt", "question", "query"), ("response", "output", "answer", "completion", "target")
OWN = ("document_type", "jurisdiction", "source", "metadata")


def coerced(value: Column) -> Column:
    """A variant's text: strings as they are, lists of strings joined by blank lines, others as JSON, null as empty."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (kind == "VOID"), "").when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        .when(kind == "ARRAY<STRING>", F.array_join(F.try_variant_get(value, "$", "array<string>"), "\n\n")).otherwise(F.to_json(value))
    )


def from_records(records: DataFrame, json_col: str = "record", text_key: str | None = None, document_type: str | None = None, jurisdiction: str | None = None, source: str | None = None) -> DataFrame:
    """records: pos, a JSON object as text and optionally a default source -> samples. The first field of an alias list that isn't null is used; the rest is metadata."""
    fields = F.from_json(F.col(json_col), "map<string,string>")
    raw = records.select("*", F.parse_json(json_col).alias("__v"), F.map_filter(fields, lambda k, v: v.isNotNull()).alias("__m"))
    first = lambda names, skip=(): F.coalesce(*[F.when(F.map_contains_key("__m", n), F.lit(n)) for n in names if n not in skip], F.lit(None).cast("string"))
    skip = (text_key,) if text_key else ()
    raw = raw.withColumns({"__i": first(INSTRUCTION, skip), "__r": first(RESPONSE, skip)})
    raw = raw.withColumn("__t", F.lit(text_key) if text_key else F.when(F.col("__i").isNotNull(), first(CONTEXT)).otherwise(first(TEXT)))
    value = lambda name: F.when(name.isNotNull(), coerced(F.try_variant_get("__v", F.concat(F.lit("$."), name), "variant")))
    given = lambda n, d: F.coalesce(F.nullif(F.element_at("__m", n), F.lit("")), F.lit(d) if not isinstance(d, Column) else d)
    used = F.array_compact(F.array("__i", "__r", "__t", *[F.lit(n) for n in OWN]))
    rest = F.map_filter(F.from_json(F.col(json_col), "map<string,variant>"), lambda k, v: ~F.array_contains(used, k))
    left = F.transform_values(rest, lambda k, v: F.to_json(v))
    inner = F.coalesce(F.transform_values(F.from_json(F.element_at("__m", "metadata"), "map<string,variant>"), lambda k, v: F.to_json(v)), F.create_map().cast("map<string,string>"))
    own = F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(inner, k)), inner)
    by_place = F.col("source") if "source" in records.columns else F.lit(source)
    return raw.select(
        "pos", F.coalesce(value(F.col("__t")), F.lit("")).alias("text"), value(F.col("__i")).alias("instruction"), value(F.col("__r")).alias("response"),
        given("document_type", document_type or "unknown").alias("document_type"), given("jurisdiction", jurisdiction).alias("jurisdiction"), given("source", by_place).alias("source"), own.alias("metadata"),
    )


def from_texts(spark: SparkSession, texts: Iterable[str], document_type: str = "unknown", jurisdiction: str | None = None, source: str | None = None) -> DataFrame:
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "pos long, text string")
    null = F.lit(None).cast("string")
    return rows.select("pos", "text", null.alias("instruction"), null.alias("response"), F.lit(document_type).alias("document_type"), F.lit(jurisdiction).cast("string").alias("jurisdiction"), F.lit(source).cast("string").alias("source"), F.create_map().cast("map<string,string>").alias("metadata"))


KINDS = ("jsonl", "json", "txt", "md")


def _name(root: str | None) -> Column:
    """A file's path below the root, or its last part."""
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return F.substring_index(path, "/", -1) if root is None else F.regexp_replace(path, "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "")


def _files(spark: SparkSession, path: str, kind: str, root: str | None, recursive: bool, whole: bool) -> DataFrame:
    """name, block, value: lines, or whole files, of that kind; hidden ones left out. No files are no rows."""
    empty = spark.createDataFrame([], "name string, block long, value string")
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if root is not None:
        either = "".join(f"[{c.lower()}{c.upper()}]" for c in kind)
        reader = reader.option("pathGlobFilter", f"*.{either}")
    try:
        rows = reader.text(path, wholetext=whole).select(_name(root).alias("name"), F.col("_metadata.file_block_start").alias("block"), "value")
    except AnalysisException as error:
        if root is not None and "PATH_NOT_FOUND" not in str(error):
            return empty
        raise
    return rows.filter(~F.col("name").rlike(r"(^|/)\."))


def _checked(record: Column, place: Column) -> Column:
    """The record, if it is a JSON object; a row that isn't raises with its place."""
    bad = F.try_parse_json(record).isNull() | ~F.ltrim(record).startswith("{")
    return F.when(bad, F.raise_error(F.concat(place, F.lit(": not a JSON object")))).otherwise(record)


def numbered_lines(lines: DataFrame) -> DataFrame:
    """name, block, value (a line each) -> name, n (its place among its file's records), record, source (name#line). Blank lines count as lines.

    Files are read in blocks, side by side. Within a block lines are numbered as they are read; how many lines and records the
    blocks before hold is summed over a table of one row a block.
    """
    read = lines.withColumn("m", F.monotonically_increasing_id())
    kept = read.filter(F.trim("value") != "").withColumn("k", F.monotonically_increasing_id())
    blocks = read.groupBy("name", "block").agg(F.min("m").alias("m0"), F.count("*").alias("lines"), F.count_if(F.trim("value") != "").alias("records"))
    firsts = kept.groupBy("name", "block").agg(F.min("k").alias("k0"))
    before = lambda c: F.coalesce(F.sum(c).over(Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.join(firsts, ["name", "block"]).select("name", "block", "m0", "k0", before("lines").alias("l"), before("records").alias("r"))
    rows = kept.join(starts, ["name", "block"]).select("name", (F.col("r") + F.col("k") - F.col("k0")).alias("n"), (F.col("l") + F.col("m") - F.col("m0") + 1).alias("line"), "value")
    place = F.concat_ws("#", "name", F.col("line").cast("string"))
    return rows.select("name", "n", _checked(F.col("value"), place).alias("record"), place.alias("source"))


def numbered_objects(files: DataFrame) -> DataFrame:
    """name, value (a JSON file: a list, or an object with ``data``) -> name, n, record, source (name#n). Such a file is one value and so one row."""
    data = F.coalesce(F.from_json("value", "array<variant>"), F.from_json("value", "struct<data:array<variant>>")["data"])
    rows = files.select("name", F.posexplode(F.when(data.isNull(), F.raise_error(F.concat("name", F.lit(": neither a list nor an object with data")))).otherwise(data)).alias("n", "v"))
    place = F.concat_ws("#", "name", (F.col("n") + 1).cast("string"))
    return rows.select("name", F.col("n").cast("long").alias("n"), _checked(F.to_json("v"), place).alias("record"), place.alias("source"))


def placed(rows: DataFrame) -> DataFrame:
    """rows: name, n -> with pos: files in the order of their names. Only a count for each file is ordered and summed."""
    files = rows.groupBy("name").agg(F.count("*").alias("size"))
    starts = files.select("name", F.coalesce(F.sum("size").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return rows.join(starts, "name").withColumn("pos", (F.col("start") + F.col("n")).cast("long")).drop("start")


def _exists(spark: SparkSession, path: str) -> bool | None:
    """Whether a file (False) or directory (True) is there; None if neither."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getFileStatus(at).isDirectory() if system.exists(at) else None


def load(spark: SparkSession, source: str, limit: int | None = None, recursive: bool = True, kinds: Iterable[str] = KINDS, **defaults) -> DataFrame:
    """Samples of a file (.jsonl, .json, .txt, .md) or of a directory of such, hidden ones left out, in the order of their paths."""
    source = os.path.expanduser(source)
    directory = _exists(spark, source)
    if directory is None:
        raise FileNotFoundError(source)
    end = source.rsplit(".", 1)[-1].lower()
    if not directory and end not in KINDS:
        raise ValueError(f"unsupported file type: {source}")
    root = source if directory else None
    rows = None
    for kind in kinds if directory else (end,):
        files = _files(spark, source, kind, root, recursive, kind != "jsonl")
        if kind == "jsonl":
            own = numbered_lines(files)
        elif kind == "json":
            own = numbered_objects(files)
        else:
            own = files.select("name", F.lit(0).cast("long").alias("n"), F.to_json(F.struct(F.col("value").alias("text"))).alias("record"), F.col("name").alias("source"))
        rows = own if rows is None else rows.unionByName(own)
    samples = from_records(placed(rows).select("pos", "record", "source"), **defaults)
    if not defaults.get("document_type"):
        samples = samples.withColumn("document_type", F.when(F.col("document_type") == "unknown", type_of_path(F.col("source"))).otherwise(F.col("document_type")))
    return samples if limit is None else samples.filter(F.col("pos") < limit)


def from_table(rows: DataFrame, order: str, text_field: str | None = None, limit: int | None = None, **defaults) -> DataFrame:
    """Samples of any table, such as a hub's rows: each row is a record. Rows with neither text nor instruction are left out and don't count for the limit.

    A text_field that isn't a column is a KeyError; without one, a table that has none of the known names is a ValueError.
    """
    names = [c for c in rows.columns if c != order]
    if text_field is not None and text_field not in names:
        raise KeyError(f"column {text_field!r} not found among {sorted(names)}")
    if text_field is None and not set(names) & {*TEXT, *INSTRUCTION}:
        raise ValueError(f"no column of text; text_field may be one of {sorted(names)}")
    records = rows.select(F.col(f"`{order}`").alias("pos"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])).alias("record"))
    kept = usable(from_records(records, text_key=text_field, **defaults))
    return kept if limit is None else kept.orderBy("pos").limit(limit)


def type_of_path(path: Column, folders: Mapping[str, str] = fixed.FOLDER_TYPES) -> Column:
    """The document type that the nearest folder of a known name gives, else unknown."""
    parts = F.split(F.lower(path), "/")
    names = F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    table = F.create_map(*[F.lit(x) for kv in folders.items() for x in kv])
    return F.coalesce(F.get(F.filter(F.transform(names, lambda n: F.try_element_at(table, n)), lambda t: t.isNotNull()), F.lit(0)), F.lit("unknown"))


def usable(samples: DataFrame) -> DataFrame:
    """Rows with a text or an instruction."""
    return samples.filter((F.col("text") != "") | F.coalesce(F.col("instruction") != "", F.lit(False)))


def as_json(samples: DataFrame) -> DataFrame:
    """pos, value: a JSON object without nulls and empty metadata."""
    own = F.transform_values("metadata", lambda k, v: F.parse_json(v))
    fields = [F.col("text"), *map(F.col, ("instruction", "response", "document_type", "jurisdiction", "source")), F.when(F.size("metadata") > 0, own).alias("metadata")]
    return samples.select("pos", F.to_json(F.struct(*fields)).alias("value"))


def write_jsonl(samples: DataFrame, path: str, files: int | None = None) -> None:
    """Lines in the order of pos; one range of it a file, so that the files in order are the whole."""
    rows = as_json(samples)
    rows = rows.coalesce(1).sortWithinPartitions("pos") if files == 1 else rows.repartitionByRange(files or 16, "pos").sortWithinPartitions("pos")
    rows.select("value").write.text(path)
