"""Line dedup over a corpus: a line that equals an earlier line, or lies one edit from one, goes. DataFrame functions only.

Lines are ordered by document and place. Equal lines are found by 128 bits of hashes. One edit is a
character inserted, deleted or substituted. Lines of all lengths are compared with
all others of their length or one more or less by a deletion-neighbourhood join: cut into segments, a pair
one edit apart differs within one segment only, so lines first meet under hashes of all but one half, then
of all but one small segment; only those that meet emit the variants of that segment with one character
deleted, as hashed keys. A substituted pair shares a variant with the place of the deletion; of an
inserted pair the longer one's variant is the shorter one. So a key's members needn't be paired among
each other: the earliest settles all, and a key that many lines share costs no more than its members. What
is found is verified by edit distance. Lines that very many documents hold are marked by a broadcast
of at most HOT_LINES keys, all others by a join, so that no line gathers its places in one task.

Defined cases: a null text stays null and has no lines; lines of white space only stay and
count as none; a text whose lines all go is empty; rows that agree in doc_id and text are one document and
lose the same lines, while rows that share only their doc_id are told apart by their texts' hashes; a null
doc_id comes first; an empty table gives an empty result; other columns come through, whatever their names; a text
of any length is split whole, a document's line marks are one row; the line that stays is the earliest, whether or not lines it resembles stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, columns, let, stored, table

#: Lines found more often than the number of lines over HOT_LINES are at most so many; below HOT_TIMES places a line isn't hot.
HOT_LINES, HOT_TIMES = 50_000, 100
NULL_ID = -(1 << 63)
_REST = "xxhash64(m, j, substring(line, 1, j * m DIV k), substring(line, n - (m - (j + 1) * m DIV k) + 1, m - (j + 1) * m DIV k))"
_MIDDLE = "substring(line, j * m DIV k + 1, n - j * m DIV k - (m - (j + 1) * m DIV k))"


def lines_of(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text -> d, t (the document's key), pos, line; without blank lines."""
    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def hashes(line: str = "line") -> list[Column]:
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), F.col(line)).alias("g")]


def _halves() -> Column:
    """The four hashes under which a line meets those one edit away."""
    half = lambda m, j: f"xxhash64({m}, {j}, substring(line, 1, {j} * {m} DIV 2), substring(line, n - ({m} - ({j} + 1) * {m} DIV 2) + 1, {m} - ({j} + 1) * {m} DIV 2))"
    return F.expr(f"array({', '.join(half(m, j) for m in ('n', '(n - 1)') for j in (0, 1))})")


def removals(docs: DataFrame, hot_times: int = HOT_TIMES) -> DataFrame:
    """docs: doc_id, text -> d, t, pos of every line that goes."""
    lines = lines_of(docs)
    keyed = lines.select("d", "t", "pos", F.length("line").alias("n"), "line").select("d", "t", "pos", *hashes(), _halves().alias("halves"))
    distinct = stored(keyed.groupBy("h", "g").agg(F.min(F.struct("d", "pos", "t")).alias("first"), F.count("*").alias("times"), F.any_value("halves").alias("halves")), "lines")
    near = near_lines(docs, distinct)
    marked = distinct.join(near.withColumn("near", F.lit(True)), ["h", "g"], "left").filter("times > 1 or near").select("h", "g", "first", "times", F.coalesce("near", F.lit(False)).alias("near"))
    total = distinct.agg(F.sum("times")).first()[0] or 0
    often = max(hot_times, total // HOT_LINES)
    goes = F.expr("near is not null and (near or (d, pos, t) <> (first.d, first.pos, first.t))")
    places = lines.select("d", "t", "pos", *hashes()).join(F.broadcast(marked.filter(F.col("times") > often).drop("times")), ["h", "g"], "left")
    # places of hot lines are decided; they go on under keys of their own, which deal them out and meet nothing
    cold = F.col("near").isNull()
    settled = places.select("d", "t", "pos", F.when(cold, F.col("h")).otherwise(F.xxhash64("d", "t", "pos")).alias("h"), F.when(cold, F.col("g")).alias("g"), goes.alias("settled"))
    return settled.join(marked.filter(F.col("times") <= often).drop("times"), ["h", "g"], "left").filter(F.col("settled") | goes).select("d", "t", "pos")


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """h, g of the distinct lines that lie one edit from an earlier one."""
    met = distinct.select("h", F.explode("halves").alias("half"))
    shared = met.groupBy("half").agg(F.count("*").alias("c")).filter("c > 1").select("half")
    wanted = met.join(shared, "half", "left_semi").select("h").distinct()
    where = distinct.join(wanted, "h", "left_semi").groupBy("first.d", "first.t").agg(F.collect_list(F.struct("first.pos", "h", "g")).alias("at"))
    texts = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), F.xxhash64("text").alias("t"), "text").join(where, ["d", "t"])
    own = let(F.split("text", "\n", -1), lambda lines: F.transform("at", lambda a: F.struct(a["pos"].alias("pos"), a["h"].alias("h"), a["g"].alias("g"), F.get(lines, a["pos"]).alias("line"))))
    some = texts.select("d", "t", F.explode(own).alias("a")).select("d", "t", "a.*")
    some = stored(some.dropDuplicates(["h", "g"]).select("h", "g", F.struct("d", "pos", "t", "h", "g").alias("at"), "line", F.length("line").alias("n")), "near-lines")
    parts = some.select("*", F.explode(F.expr("array(n, n - 1)")).alias("m")).withColumn("k", F.expr("CAST(greatest(2, floor(sqrt(m))) AS INT)"))
    cut = parts.select("*", F.explode(F.expr("sequence(0, k - 1)")).alias("j")).select("at", "n", "m", F.expr(_REST).alias("rest"), F.expr(_MIDDLE).alias("middle"))
    crowd = cut.groupBy("rest").agg(F.count("*").alias("c"), F.min("n").alias("least"), F.max("n").alias("most")).filter("c > 1").select("rest")
    cut = cut.join(crowd, "rest", "left_semi")
    # variants: (0, place, text) for a substitution at that place, (1, null, text) for a deletion, or for the line itself
    deleted = "transform(sequence(1, length(middle)), i -> struct({0}, false AS own, xxhash64({0}, {1}, rest, concat(substring(middle, 1, i - 1), substring(middle, i + 1))) AS key))"
    whole = "array(struct(1 AS kind, true AS own, xxhash64(1, 0, rest, middle) AS key))"
    subst = deleted.format("0", "i").replace("struct(0,", "struct(0 AS kind,")
    short = deleted.format("1", "0").replace("struct(1,", "struct(1 AS kind,")
    keys = F.expr(f"CASE WHEN n = m THEN concat({whole}, CASE WHEN middle = '' THEN array() ELSE {subst} END) WHEN middle <> '' THEN {short} ELSE array() END")
    variants = cut.select("at", F.explode(keys).alias("v")).select("at", "v.kind", "v.own", "v.key")
    firsts = variants.groupBy("kind", "key").agg(F.min(F.when(F.col("own"), F.col("at"))).alias("of_own"), F.min(F.when(~F.col("own"), F.col("at"))).alias("of_other"), F.count("*").alias("c")).filter("c > 1 and (kind = 0 or (of_own is not null and of_other is not null))")
    before = F.when(F.col("own"), F.col("of_other")).when(F.col("kind") == 1, F.col("of_own")).otherwise(F.col("of_other"))
    pairs = variants.join(firsts.select("kind", "key", "of_own", "of_other"), ["kind", "key"]).select("at", before.alias("before")).filter("before < at").distinct()
    text = some.select(F.col("h"), F.col("g"), F.col("line"))
    both = pairs.select(F.col("at.h").alias("h"), F.col("at.g").alias("g"), F.col("before.h").alias("h2"), F.col("before.g").alias("g2"))
    both = both.join(text, ["h", "g"]).join(text.toDF("h2", "g2", "line2"), ["h2", "g2"])
    return both.filter(F.levenshtein("line", "line2", 1).between(0, 1)).select("h", "g").distinct()


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (all columns of docs), n_lines, n_removed, text."""
    gone = removals(columns(docs, doc_id=id_col, text=text_col))
    words = gone.groupBy("d", "t", F.expr("pos DIV 64").cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    masks = words.groupBy("d", "t").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("mask"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("d"), F.xxhash64(F.col(f"`{text_col}`")).alias("t"))
    rows = rows.join(masks, ["d", "t"], "left").select("row", "mask", F.split(F.col(f"row.`{text_col}`"), "\n", -1).alias("lines"))
    dense = F.expr("transform(sequence(0, array_max(map_keys(mask))), w -> coalesce(mask[w], 0L))")
    stays = lambda mask: F.filter("lines", lambda x, i: F.coalesce(F.getbit(F.get(mask, F.shiftright(i, 6)), i % 64), F.lit(0)) == 0)
    kept = F.when(F.col("mask").isNull(), F.col("lines")).otherwise(let(dense, stays))
    counted = rows.select("row", "lines", kept.alias("kept"))
    full = F.expr(r"size(filter(lines, x -> x rlike '[^\\x20\\x09-\\x0D]'))")
    return counted.select("row", F.greatest(F.lit(0), full).cast("long").alias("n_lines"), F.greatest(F.lit(0), F.size("lines") - F.size("kept")).cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("text"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with all columns, the text without lines that repeat, and n_chars, if there, made anew."""
    out = without_repeats(docs, id_col, text_col)
    new = {text_col: F.col("text")} | ({chars_col: F.length("text").cast(docs.schema[chars_col].dataType)} if chars_col in docs.columns else {})
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("row.doc_id", "n_lines", "n_removed", "text")


_BLANK = r"[^\x20\x09-\x0D]"
SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
), u AS (SELECT * FROM l WHERE regexp_matches(line, '{_BLANK}')),
f AS (SELECT line, min((doc_id, pos)) AS top, length(line) AS n FROM u GROUP BY line),
s AS (SELECT *, unnest([n, n - 1]) AS m FROM f),
k AS (SELECT line, top, n, m, 0 AS half, left(line, m // 2) AS part FROM s UNION ALL SELECT line, top, n, m, 1, right(line, m - m // 2) FROM s),
near AS (
  SELECT DISTINCT b.line FROM k a JOIN k b ON a.half = b.half AND a.part = b.part AND a.m = b.m AND a.top < b.top AND abs(a.n - b.n) <= 1
  WHERE a.line <> b.line AND CASE
    WHEN a.n = b.n THEN len(list_filter(list_zip(string_split(a.line, ''), string_split(b.line, '')), lambda x: x[1] <> x[2])) = 1
    WHEN a.n < b.n THEN len(list_filter(range(1, b.n + 1), lambda i: left(b.line, i - 1) || substr(b.line, i + 1) = a.line)) > 0
    ELSE len(list_filter(range(1, a.n + 1), lambda i: left(a.line, i - 1) || substr(a.line, i + 1) = b.line)) > 0 END
), gone AS (
  SELECT u.doc_id, u.pos FROM u JOIN f USING (line) WHERE (u.doc_id, u.pos) <> f.top OR u.line IN (SELECT line FROM near)
), kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY l.doc_id
), sums AS (SELECT doc_id, count(*) AS n_lines FROM u GROUP BY doc_id), lost AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id) LEFT JOIN lost USING (doc_id)
"""
