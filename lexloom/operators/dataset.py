"""Operators over whole datasets of samples: exact dedup, shuffling, splits, statistics, preprocessing, chunking, training data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import chunks, citations, pii, prompts
from lexloom.functions import text as T

SPLITS = ("train", "validation", "test")
#: A unit that holds more than this share of all rows is dealt on its own; there can't be more than its inverse of them.
LARGE = 1000
#: Ranges that the other units' order is cut into, each summed up by itself.
RANGES = 4096


#: Bytes of a table's files, as they are stored, that are worth a task of their own where a row takes much work; tasks to a core.
TASK_BYTES, TASKS_PER_CORE = 16 * 1024, 4


def dealt(rows: DataFrame) -> DataFrame:
    """The rows of a table dealt out evenly, by all their columns, for work that takes long on each.

    Small rows are stored up to a million to a row group, which is one task of a scan however many cores there are.
    """
    spark = rows.sparkSession
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = min(size // TASK_BYTES + 1, most)
    return rows.repartition(tasks, *rows.columns) if tasks > 1 else rows


# ---- places ----


def at(samples: DataFrame, index: int, order: str = "pos") -> DataFrame:
    """The row at that place, from the end if negative; none beyond the ends."""
    return between(samples, index, index + 1 if index != -1 else None, order)


def between(samples: DataFrame, start: int | None = None, stop: int | None = None, order: str = "pos") -> DataFrame:
    """Rows from one place to another, as Python slices do; places are ranks by ``order``, which is unique."""
    places = numbered(samples.select(order), order, "__at")
    size = samples.agg(F.count("*")).scalar()
    place = lambda k: F.lit(k) if k is None or k >= 0 else F.greatest(F.lit(0), size + k)
    own = F.col("__at")
    wanted = places.filter((own >= place(start or 0)) & ((own < place(stop)) if stop is not None else F.lit(True))).select(order)
    return samples.join(wanted, order, "left_semi")


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with their rank by a unique long from 0: counts of ranges of its values are summed first, then each range ranks its own rows."""
    ends = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    width = (F.col("hi") - F.col("lo")).cast("double") + 1
    bucket = F.floor((F.col(order) - ends.select("lo").scalar()).cast("double") / ends.select(width).scalar() * RANGES)
    dealt = rows.withColumn("__b", bucket)
    counts = dealt.groupBy("__b").agg(F.count("*").alias("__n"))
    before = counts.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))
    ranks = F.row_number().over(Window.partitionBy("__b").orderBy(order)) - 1
    return dealt.join(F.broadcast(before), "__b").withColumn(name, F.col("__before") + ranks).drop("__b", "__before")


def extended(samples: DataFrame, more: DataFrame, order: str = "pos") -> DataFrame:
    """Both tables' rows, those of the second placed behind the first."""
    ends = samples.agg(F.coalesce(F.max(order) + 1, F.lit(0)).alias("n")).scalar()
    least = more.agg(F.min(order).alias("n")).scalar()
    return samples.unionByName(more.withColumn(order, (F.col(order) - least + ends).cast(samples.schema[order].dataType)))


def deduplicate(samples: DataFrame, *columns: str, order: str = "pos") -> DataFrame:
    """The first row, by order, for each fingerprint of the columns; among rows in the same place that with the least hash of all its values.

    Only fingerprints, places and hashes are aggregated, partly before the shuffle, so that a text that a third of
    all rows share is no burden; texts are then kept by a semi-join.
    """
    names = columns or ("instruction", "text", "response")
    maps = {f.name for f in samples.schema.fields if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString()}
    row = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if c in maps else F.col(f"`{c}`") for c in samples.columns])
    own = samples.withColumn("__row", row)
    first = own.groupBy(T.fingerprint(*[F.col(c) for c in names]).alias("fp")).agg(F.min(F.struct(F.col(order).alias("o"), F.col("__row").alias("r"))).alias("x")).select(F.col("x.o").alias("__o"), F.col("x.r").alias("__r"))
    return own.join(first, (F.col(order) == F.col("__o")) & (F.col("__row") == F.col("__r")), "left_semi").drop("__row")


def shuffled(samples: DataFrame, seed: int = 42, order: str = "pos") -> DataFrame:
    """A permutation that depends on the seed and the rows' places alone."""
    return samples.withColumn("__key", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(order).cast("string")), 256)).orderBy("__key", order).drop("__key")


# ---- splits ----


def group_key(samples: DataFrame, name: str) -> Column:
    """What rows are kept together by: a column, else a key of the metadata (as its JSON text); null for neither."""
    return F.col(name) if name in samples.columns else F.try_element_at("metadata", F.lit(name)) if "metadata" in samples.columns else F.lit(None).cast("string")


def split(samples: DataFrame, train: float = 0.8, validation: float = 0.1, test: float = 0.1, seed: int = 42, shuffle: bool = True, group: Column | str | None = None, order: str = "pos") -> DataFrame:
    """samples with ``split``. Rows of a group stay together; a row without one, or whose group is null, is its own unit.

    Units that hold more than a thousandth of all rows each go, in order, to the split that lacks most of its share.
    The others then fill what is still lacking: by the middle of their stretch of the order's running sum of
    rows. The first kind can't be more than a thousand, whatever the input; the second is summed by ranges.
    """
    shares = (train, validation, test)
    if min(shares) < 0 or abs(sum(shares) - 1) > 1e-6:
        raise ValueError("the fractions must be at least 0 and sum to 1")
    group = group_key(samples, group) if isinstance(group, str) else group
    own = F.concat(F.lit("#"), F.col(order).cast("string"))
    marked = samples.withColumn("__unit", own if group is None else F.coalesce(F.concat(F.lit("="), group.cast("string")), own))
    units = marked.groupBy("__unit").agg(F.count("*").alias("n"), F.min(order).cast("long").alias("first"))
    units = units.withColumn("key", F.xxhash64(F.lit(seed), "__unit") if shuffle else F.col("first"))
    total = units.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("t")).scalar()
    large = F.col("n") * LARGE > total
    dealt = _dealt(units.filter(large), total, shares)
    lacking = [F.greatest(F.lit(0.0), dealt.select(F.col("row.left")[k].alias("x")).scalar()) for k in range(3)]
    few = dealt.select(F.explode("row.out").alias("x")).select(F.col("x.u").alias("__unit"), F.col("x.s").alias("split"))
    return marked.join(few.unionByName(_filled(units.filter(~large), lacking)), "__unit").drop("__unit")


def _dealt(units: DataFrame, total: Column, shares: tuple[float, float, float]) -> DataFrame:
    """One row: what each split still lacks, and the split of each of these units."""
    goals = ", ".join(f"CAST({s!r} AS DOUBLE)" for s in shares)
    names = ", ".join(f"'{s}'" for s in SPLITS)
    fold = f"""
      aggregate(units, named_struct('left', transform(array({goals}), s -> s * total), 'out', CAST(array() AS ARRAY<STRUCT<u: STRING, s: STRING>>)),
        (acc, x) -> transform(array(array_position(acc.left, array_max(filter(acc.left, (d, i) -> array({goals})[i] > 0)))), k -> named_struct(
          'left', transform(acc.left, (d, i) -> IF(i = k - 1, d - x.n, d)), 'out', array_append(acc.out, named_struct('u', x.u, 's', array({names})[CAST(k AS INT) - 1]))))[0])"""
    row = units.agg(F.array_sort(F.collect_list(F.struct("key", "first", F.col("__unit").alias("u"), F.col("n").cast("double").alias("n")))).alias("units")).withColumn("total", total)
    return row.select(F.expr(fold).alias("row"))


def _filled(units: DataFrame, lacking: list[Column]) -> DataFrame:
    """__unit, split: stretches of the order's running sum, as long as each split lacks."""
    ends = units.agg(F.min("key").cast("double").alias("lo"), F.max("key").cast("double").alias("hi"), F.sum("n").cast("double").alias("n"))
    lo, hi, n = (ends.select(c).scalar() for c in ("lo", "hi", "n"))
    dealt = units.withColumn("b", F.floor((F.col("key").cast("double") - lo) / (hi - lo + 1) * RANGES))
    sums = dealt.groupBy("b").agg(F.sum("n").alias("sum"))
    before = sums.select("b", (F.sum("sum").over(Window.orderBy("b")) - F.col("sum")).alias("before"))
    run = F.sum("n").over(Window.partitionBy("b").orderBy("key", "first", "__unit").rowsBetween(Window.unboundedPreceding, 0))
    middle = (F.col("before") + run - F.col("n") / 2) / n * (lacking[0] + lacking[1] + lacking[2])
    name = F.when(middle < lacking[0], SPLITS[0]).when((middle < lacking[0] + lacking[1]) | (lacking[2] == 0) & (lacking[1] > 0), SPLITS[1]).when(lacking[2] > 0, SPLITS[2]).otherwise(SPLITS[0])
    return dealt.join(F.broadcast(before), "b").select("__unit", name.alias("split"))


# ---- statistics ----


def statistics(samples: DataFrame) -> DataFrame:
    """One row: counts, characters of text, instruction and response, tokens, and counts by type and jurisdiction. One pass over the samples."""
    size = sum((F.char_length(F.coalesce(F.col(c), F.lit(""))) for c in ("text", "instruction", "response")), F.lit(0)).cast("long")
    rows = samples.select(size.alias("n"), prompts.is_instruction(F.col("instruction"), F.col("response")).cast("long").alias("i"), "document_type", F.coalesce("jurisdiction", F.lit("unknown")).alias("jurisdiction"))
    sets = rows.groupingSets([[], ["document_type"], ["jurisdiction"]], "document_type", "jurisdiction")
    sums = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("rows"), F.sum("i").alias("i"), F.sum("n").alias("n"), F.min("n").alias("least"), F.max("n").alias("most"))
    whole = lambda c: F.coalesce(F.max(F.when(F.col("g") == 3, F.col(c))), F.lit(0))
    counts = lambda c, g: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("g") == g, F.struct(F.coalesce(c, F.lit("unknown")).alias(c), "rows")))))
    out = sums.agg(
        whole("rows").alias("num_samples"), whole("i").alias("num_instructions"), whole("n").alias("total_chars"), whole("least").alias("min_chars"), whole("most").alias("max_chars"),
        counts("document_type", 1).alias("document_types"), counts("jurisdiction", 2).alias("jurisdictions"),
    )
    mean = F.when(F.col("num_samples") > 0, F.col("total_chars") / F.col("num_samples")).otherwise(0.0)
    return out.select("num_samples", "num_instructions", "total_chars", "min_chars", "max_chars", mean.alias("avg_chars"), F.floor(F.col("total_chars") / 4).alias("estimated_tokens"), "document_types", "jurisdictions")


def processing_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs as processed() gives them, with ``statistics``: sizes, reduction in per cent, citations by type and jurisdiction, chunks, entities."""
    none = F.lit(None).cast("long")
    before, after = F.char_length(text), F.char_length("processed")
    cited = F.col("citations") if "citations" in docs.columns else F.array().cast(f"array<{citations.STRUCT}>")

    def counted(field: str) -> Column:
        values = F.transform(cited, lambda c: c[field])
        each = F.transform(F.array_sort(F.array_distinct(values)), lambda v: F.struct(v.alias("key"), F.size(F.filter(values, lambda x: x == v)).alias("value")))
        return F.map_from_entries(each)

    return docs.withColumn(
        "statistics",
        F.struct(
            before.alias("original_chars"), after.alias("processed_chars"), F.when(before > 0, (1 - after / before) * 100).otherwise(0.0).alias("reduction_pct"), F.size(cited).alias("citation_count"),
            counted("type").alias("citations_by_type"), counted("jurisdiction").alias("citations_by_jurisdiction"), (F.size("chunks") if "chunks" in docs.columns else F.lit(0)).alias("chunk_count"),
            (F.size("anonymisation.entities").cast("long") if "anonymisation" in docs.columns else none).alias("entities_anonymised"),
            (F.size("anonymisation.mapping").cast("long") if "anonymisation" in docs.columns else none).alias("unique_entities"),
        ),
    )


# ---- documents ----


def processed(docs: DataFrame, text: str = "text", headers: bool = False, extract: bool = True, normalise: bool = True, anonymise: bool = False, chunk: bool = False, options: dict | None = None, chunking: dict | None = None) -> DataFrame:
    """docs with processed, citations (offsets into the cleaned text), anonymisation and chunks, each computed only if asked for."""
    clean = T.clean_whitespace(F.col(text))
    out = docs.withColumn("processed", T.drop_page_lines(clean) if headers else clean)
    if extract:
        out = out.withColumn("citations", citations.citations_of(F.col("processed")))
        out = out.withColumn("processed", citations.with_normal_citations(F.col("processed"))) if normalise else out
    if anonymise:
        out = out.withColumn("anonymisation", pii.anonymised(F.col("processed"), **(options or {}))).withColumn("processed", F.col("anonymisation.text"))
    return out.withColumn("chunks", chunks.chunks_of(F.col("processed"), **(chunking or {}))) if chunk else out


def _json_text(value: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)


def chunked(samples: DataFrame, **options) -> DataFrame:
    """A row for each chunk of a text; instructions and empty texts pass, blank texts go. Adds document_id and the chunk's place to the metadata."""
    passes = prompts.is_instruction(F.col("instruction"), F.col("response")) | (F.col("text") == "")
    cut = samples.filter(~passes).withColumn("__c", chunks.chunks_of(F.col("text"), **options))
    each = cut.select("*", F.size("__c").alias("__n"), F.posexplode("__c").alias("__k", "__x"))
    own = F.coalesce(F.try_element_at("metadata", F.lit("document_id")), _json_text(F.concat_ws("#", F.coalesce("source", F.lit("sample")), F.col("pos").cast("string"))))
    section = F.when(F.col("__x.section") != "", _json_text(F.col("__x.section")))
    new = {"document_id": own, "chunk_index": F.col("__k"), "chunk_count": F.col("__n"), "start_char": F.col("__x.start_char"), "end_char": F.col("__x.end_char"), "section": section}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in new.items()])
    added = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    kept = F.map_filter("metadata", lambda k, v: ~k.isin(*new))
    columns = {"text": F.col("__x.text"), "metadata": F.map_concat(kept, added)}
    return samples.filter(passes).unionByName(each.select(*[columns.get(c, F.col(c)).alias(c) for c in samples.columns]))


def chunk_records(docs: DataFrame, name: str = "source", text: str = "text", **options) -> DataFrame:
    """text, source, chunk_index, start_char, end_char, section of every chunk of the cleaned texts."""
    each = docs.select(F.col(name).alias("source"), F.posexplode(chunks.chunks_of(T.clean_whitespace(F.col(text)), **options)).alias("chunk_index", "x"))
    return each.select("x.text", "source", "chunk_index", "x.start_char", "x.end_char", "x.section")


def preprocessed(samples: DataFrame, anonymise: bool = True, jurisdiction: str | None = None, keep_metadata: tuple[str, ...] = (), **options) -> DataFrame:
    """samples cleaned, with citations counted and, if asked for, personal data replaced in all fields under one numbering."""
    clean = T.clean_whitespace(F.col("text"))
    out = samples.withColumn("text", clean).withColumn("__n", F.size(citations.citations_of(F.col("text"))).cast("string"))
    out = out.withColumn("text", citations.with_normal_citations(F.col("text")))
    added = F.create_map(F.lit("citation_count"), F.col("__n"))
    if anonymise:
        out = out.withColumn("__a", pii.anonymised_fields(F.array("text", "instruction", "response"), F.col("metadata"), keep_metadata, **options))
        out = out.withColumns({"text": F.col("__a.fields")[0], "instruction": F.col("__a.fields")[1], "response": F.col("__a.fields")[2], "metadata": F.col("__a.metadata")}).drop("__a")
        added = F.create_map(F.lit("citation_count"), F.col("__n"), F.lit("anonymised"), F.lit("true"))
    kept = F.map_filter("metadata", lambda k, v: ~k.isin("citation_count", "anonymised"))
    return out.withColumn("metadata", F.map_concat(kept, added)).withColumn("jurisdiction", F.coalesce("jurisdiction", F.lit(jurisdiction))).drop("__n")


# ---- training data ----


def rendered(samples: DataFrame, template: str = "alpaca", column: str = "text", system: str | None = None) -> DataFrame:
    """One column of training texts, or ``messages`` if that is the template (which needs instructions throughout)."""
    text, instruction, response = F.col("text"), F.col("instruction"), F.col("response")
    if template == "messages":
        return samples.select(prompts.messages(text, instruction, response, system).alias("messages"))
    return samples.select(prompts.training_text(text, instruction, response, template, system).alias(column))


def too_long(samples: DataFrame, longest: int) -> DataFrame:
    """Documents, not instructions, of more characters than a model's sequence is taken to hold."""
    return samples.filter(~prompts.is_instruction(F.col("instruction"), F.col("response")) & (F.char_length("text") > longest * 4))


def training_rows(samples: DataFrame, longest: int = 2048, anonymise: bool = False, jurisdiction: str = "uk", keep_names: bool = True, template: str = "alpaca", column: str = "text") -> DataFrame:
    """What a trainer reads: samples preprocessed, if asked for, and rendered. Raises on an empty table; too_long() tells what would be cut off."""
    if samples.isEmpty():
        raise ValueError("the training dataset is empty")
    rows = preprocessed(samples, True, jurisdiction, keep_names=keep_names) if anonymise else samples
    return rendered(rows, template, column)


def entity_counts(entities: Iterable[Column] | Column, docs: DataFrame) -> DataFrame:
    """entity_type, n over all rows' arrays of entities, by name."""
    each = docs.select(F.explode(entities).alias("e"))
    return each.groupBy("e.entity_type").agg(F.count("*").alias("n")).orderBy("entity_type")
