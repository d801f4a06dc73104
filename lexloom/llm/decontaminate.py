"""Benchmark decontamination by template windows, with DataFrame functions only.

Numbers, units after numbers and runs of names become typed placeholders; the rest is lower-cased words. What
is a name is the same for all texts: a word that the benchmark has capitalised and never in
lower case, in any case; else a capitalised word that the benchmark never has in lower case; a word that
it has both ways is one where it is capitalised within a sentence. So a copy in capitals or in lower case is
found, and any name, of several words too, may stand in a name's place. Words are known by BUCKETS hashes.

Windows of five template words, two of them no placeholders, are hashed. Of an item with n windows the
rarest n - ceil(0.8 n) + 1 are its keys, going by their rarest word in a sample of the documents: a document that holds
0.8 of them holds one of these. A document that holds a key holds all its literal words, so only documents
with all plain words of some key are cut into windows, as long as there are at most FILTER_KEYS keys and each has a plain
word; else all are. Documents' windows meet the keys in a hash join; documents and items that met are then compared on all windows, so that
a window which many items share brings no pairs of its own. A document leaks an item if at one alignment, or within
a fifth of the item's length of one (words put in or left out), at least 0.8 of the item's windows match and the slots
are consistent: one value in the item stands for one value in the document, and the other way round.
An item with fewer than five template words, or without windows, is found where all its words stand in a
row, unchanged; one of fewer than three words only where it is the whole document.

Defined cases: a null text has no words; an item without words is never found; repeated items are
reported each, repeated documents are told apart by doc_id and text, so a repeated row is reported once; of several alignments of a
pair that with most windows is reported, then the earliest; an empty table gives an empty result; other columns of
both tables play no part; a text of any length is compared whole, with its windows as one row's array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, let, stored, table

WINDOW, SHARE, LITERALS, SHORTEST = 5, 0.8, 2, 3
BUCKETS = 1 << 20
#: Rows of 16 to 24 bytes up to which keys and candidates are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Words of these letters are plain: lower() makes them the same in any place, and nothing that it makes into another letter stands beside them.
PLAIN = "a-zß-öø-ÿ"
#: Keys up to which documents are first sorted out by their words, and one document in SAMPLE tells which words are rare. Neither alters what is found.
FILTER_KEYS, SAMPLE = 20_000, 32
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "mm cm km m metre metres meter meters kilometre kilometres kilometer kilometers inch inches feet foot ft yard yards mile miles mg kg g gram grams kilogram kilograms ton tons tonne tonnes pound pounds lb lbs ounce ounces oz ml l litre litres liter liters "
    "gallon gallons second seconds sec secs minute minutes min mins hour hours hr hrs day days week weeks month months year years euro euros eur dollar dollars usd cent cents gbp percent degree degrees mph kmh watt watts kw kwh volt volts amp amps hz khz mhz ghz kb mb gb tb acre acres hectare hectares"
).split()
END = "¶"


def raw_words(text: Column) -> Column:
    """The words, with END at those before the end of a sentence or line; separators within numbers are taken out, a number's unit is a word."""
    marked = F.translate(F.regexp_replace(text, r"(?<=\d)[.,:/](?=\d)", ""), ".!?:\n", END * 5)
    return F.filter(F.split(F.regexp_replace(marked, rf"[^\p{{L}}\p{{N}}{END}]+|(?<=\d)(?=\p{{L}})", " "), " "), lambda w: F.btrim(w, F.lit(END)) != "")


def lowered(raw: Column) -> Column:
    return F.transform(raw, lambda w: F.lower(F.btrim(w, F.lit(END))))


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def is_capitalised(raw: Column, low: Column) -> Column:
    """An upper-case letter with no other after it."""
    own = F.btrim(raw, F.lit(END))
    return (F.substring(own, 1, 1) != F.substring(low, 1, 1)) & (F.length(own) > 1) & (F.substring(own, 2, 1) == F.substring(low, 2, 1))


def starts(raw: Column, at: Column) -> Column:
    return (at == 0) | F.get(raw, at - 1).endswith(END)


class Names:
    """only: buckets of names, both: of words that are names in some places. At most BUCKETS numbers, whatever the benchmark."""

    def __init__(self, items: DataFrame):
        """items: text. A bucket's kinds are summed over all items."""
        seen = items.select(let(raw_words(F.col("text")), lambda raw: let(lowered(raw), lambda low: F.transform(low, lambda w, i: F.struct(bucket(w).alias("b"), is_capitalised(F.get(raw, i), w).alias("cap"), starts(raw, i).alias("first"))))).alias("w"))
        flat = seen.select(F.explode("w").alias("w")).select("w.*").filter("cap is not null").groupBy("b").agg(F.max(F.col("cap").cast("int")).alias("name"), F.max((F.col("cap") & ~F.col("first")).cast("int")).alias("inner"), F.max((~F.col("cap")).cast("int")).alias("word"))
        got = flat.collect()
        self.only = sorted(r.b for r in got if r.name and not r.word)
        self.both = sorted(r.b for r in got if r.inner and r.word)
        self.words = sorted(r.b for r in got if r.word and not r.inner)

    def kinds(self, raw: Column, low: Column) -> Column:
        """Placeholder or lower-case word of each word."""
        digit = lambda w: w.between("0", ":") | w.isin(NUMBER_WORDS)
        within = lambda w, some: bucket(w).isin(some) if some else F.lit(False)

        def kind(w: Column, i: Column) -> Column:
            name = is_capitalised(F.get(raw, i), w) & ~within(w, self.words) & ~(starts(raw, i) & within(w, self.both))
            return F.when(digit(w), "§d").when(w.isin(UNITS) & (i > 0) & digit(F.get(low, i - 1)), "§u").when(within(w, self.only) | name, "§n").otherwise(w)

        return F.transform(low, kind)


def merged(kinds: Column) -> Column:
    """The places of the template's words: of a run of names or numbers the first."""
    return F.filter(F.sequence(F.lit(0), F.size(kinds) - 1), lambda i: ~((i > 0) & F.get(kinds, i).isin("§n", "§d") & (F.get(kinds, i) == F.get(kinds, i - 1))))


def hash_of(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(width)])


def places(words: Column, width: int) -> Column:
    return F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))


def window_hashes(names: Names) -> Column:
    """array<long> of the column ``text``: hashes of its template windows."""

    def of_template(raw: Column, low: Column) -> Column:
        words = let(names.kinds(raw, low), lambda k: F.transform(merged(k), lambda i: F.get(k, i)))
        return let(words, lambda c: F.transform(places(c, WINDOW), lambda i: hash_of(c, i, WINDOW)))

    return let(raw_words(F.col("text")), lambda raw: let(lowered(raw), lambda low: F.when(F.size(low) > 0, of_template(raw, low))))


def windowed(rows: DataFrame, names: Names, *keep: str) -> DataFrame:
    """rows: text -> the columns named, n_words and a row per window: at (in the template), word (in the text), hash, template and values."""

    def cut(low: Column, kinds: Column) -> Column:
        def of(where: Column) -> Column:
            values = F.transform(where, lambda i, k: F.array_join(F.slice(low, i + 1, F.coalesce(F.get(where, k + 1), F.size(low)) - i), " "))
            words = F.transform(where, lambda i: F.get(kinds, i))
            part = lambda c, v, k: F.struct(k.alias("at"), F.get(where, k).alias("word"), hash_of(c, k, WINDOW).alias("hash"), F.slice(c, k + 1, WINDOW).alias("template"), F.slice(v, k + 1, WINDOW).alias("values"))
            return let(words, lambda c: let(values, lambda v: F.transform(places(c, WINDOW), lambda k: part(c, v, k))))

        return let(merged(kinds), of)

    made = let(raw_words(F.col("text")), lambda raw: let(lowered(raw), lambda low: F.when(F.size(low) > 0, let(names.kinds(raw, low), lambda kinds: cut(low, kinds)))))
    out = rows.select(*keep, F.explode(made).alias("x")).select(*keep, "x.*")
    return out.filter(F.expr(f"size(filter(template, x -> not startswith(x, '§'))) >= {LITERALS}"))


def short_items(items: DataFrame, long: DataFrame) -> DataFrame:
    """item_id, item_text, n, words: items without windows, by all their words."""
    words = items.join(long.select("item_id", "item_text"), ["item_id", "item_text"], "left_anti").select("item_id", "item_text", lowered(raw_words(F.col("text"))).alias("low"))
    return words.filter(F.size("low") > 0).select("item_id", "item_text", F.size("low").alias("n"), F.array_join("low", " ").alias("words"))


def sent(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def plain_words(text: Column) -> Column:
    """Every run of plain letters; all words of the text that are plain are among them."""
    return F.split(F.lower(text), f"[^{PLAIN}]+")


def holding(rows: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """rows: text; keys: words, the rarest first. The rows that hold all words of some key; all rows if there are over ``most`` keys or one has no words."""
    listed = keys.select("words").distinct().limit(most + 1).collect()
    if len(listed) > most or not all(r.words for r in listed):
        return rows
    by_first: dict[str, list[str]] = {}
    for r in listed:
        by_first.setdefault(r.words[0], []).append("array({})".format(", ".join(f"'{w}'" for w in r.words)))
    if not by_first:
        return rows.limit(0)
    known = "map({})".format(", ".join(f"'{w}', array({', '.join(x)})" for w, x in by_first.items()))
    firsts = ", ".join(f"'{w}'" for w in by_first)
    return rows.filter(F.expr(f"get(transform(array(split(lower(text), '[^{PLAIN}]+')), t -> exists(filter(t, w -> w IN ({firsts})), w -> exists(element_at({known}, w), k -> forall(k, x -> array_contains(t, x))))), 0)"))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = SHARE, most: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text_hash, item_id, share, first_word, changed (the values differ from the item's): a row per leaking pair."""
    items = columns(items, item_id=item_col, text=item_text).filter("text is not null").withColumn("item_text", F.xxhash64("text")).dropDuplicates(["item_id", "item_text"])
    rows = columns(docs, doc_id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text"))
    names = Names(items.select("text"))
    listed = stored(windowed(items, names, "item_id", "item_text").select("item_id", "item_text", "at", "hash", "template", F.col("values").alias("own")), "benchmark")
    sizes = listed.groupBy("item_id", "item_text").agg(F.count("*").alias("n_windows"))
    keys, few = stored(keys_of(listed, sizes, share, rows), "keys"), stored(short_items(items, sizes), "short-items")
    met = holding(rows, keys, min(most, FILTER_KEYS)).select("doc_id", "text_hash", F.explode(window_hashes(names)).alias("hash"))
    candidates = stored(met.join(sent(keys.drop("words"), keys.count(), most), "hash").select("doc_id", "text_hash", "item_id", "item_text").distinct(), "candidates")
    held = candidates.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
    pairs = candidates.count()
    texts = rows.join(sent(held, pairs, most), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    found = windowed(texts, names, "doc_id", "text_hash").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("at").alias("place"), "word", "hash", F.col("values").alias("found"))
    both = found.join(sent(candidates, pairs, most), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))).join(listed, ["item_id", "item_text", "hash"]).join(sizes, ["item_id", "item_text"])
    good = aligned(both, share)
    key = ["doc_id", "text_hash", "item_id", "item_text"]
    best = good.groupBy(*key).agg(F.max(F.struct("n", (-F.col("word")).alias("back"), (F.col("n") / F.col("n_windows")).alias("share"), F.expr("exists(slots, x -> x.own <> x.found)").alias("changed"))).alias("b"))
    out = best.select("doc_id", "text_hash", "item_id", F.col("b.share").alias("share"), (-F.col("b.back")).cast("long").alias("first_word"), F.col("b.changed").alias("changed"))
    return out if few.isEmpty() else out.union(short_leaks(rows, few))


def keys_of(listed: DataFrame, sizes: DataFrame, share: float, rows: DataFrame) -> DataFrame:
    """hash, item_id, item_text, words: of each item so many of its windows that a match holds one of them, those with the rarest words. words: the plain ones, the rarest first.

    rows: text, text_hash. How many of a sample of them hold a word only sets the order.
    """
    often = listed.groupBy("hash").agg(F.count("*").alias("times"))
    own = listed.select("hash", F.explode(F.array_distinct("template")).alias("word")).filter(F.col("word").rlike(f"^[{PLAIN}]+$")).distinct()
    sample = rows.filter(F.pmod("text_hash", F.lit(SAMPLE)) == 0).select(F.explode(F.array_distinct(plain_words(F.col("text")))).alias("word"))
    held = sample.groupBy("word").agg(F.count("*").alias("held"))
    words = own.join(held, "word", "left").groupBy("hash").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), (-F.length("word")).alias("short"), "word"))).alias("w"))
    known = listed.join(often, "hash").join(words, "hash", "left").join(sizes, ["item_id", "item_text"])
    order = Window.partitionBy("item_id", "item_text").orderBy(F.expr("w[0].held").asc_nulls_last(), "times", "hash", "at")
    ranked = known.withColumn("nth", F.row_number().over(order))
    chosen = ranked.filter(F.col("nth") <= F.col("n_windows") - F.ceil(F.col("n_windows") * share - 1e-9) + 1)
    return chosen.select("hash", "item_id", "item_text", F.coalesce(F.col("w.word"), F.array().cast("array<string>")).alias("words")).distinct()


def aligned(both: DataFrame, share: float) -> DataFrame:
    """both: a row per matching window of a document and an item -> those alignments whose windows suffice and whose slots are consistent."""
    slots = F.expr("transform(filter(arrays_zip(template, own, found), x -> startswith(x.template, '§')), x -> struct(x.own, x.found))")
    start, reach = F.col("place") - F.col("at"), F.greatest(F.lit(2), F.floor(F.col("n_windows") * (1 - share))).cast("int")
    near = [F.struct(F.lit(k).alias("k"), w.cast("long").alias("s")) for k, w in ((0, start), (1, F.floor(start / (2 * reach))), (2, F.floor((start + reach) / (2 * reach))))]
    each = both.select("doc_id", "text_hash", "item_id", "item_text", "n_windows", "at", "word", slots.alias("slots"), F.explode(F.array(*near)).alias("where"))
    sums = each.groupBy("doc_id", "text_hash", "item_id", "item_text", "n_windows", "where").agg(F.size(F.collect_set("at")).alias("n"), F.min("word").alias("word"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    own, found = F.expr("array_distinct(transform(slots, x -> x.own))"), F.expr("array_distinct(transform(slots, x -> x.found))")
    return sums.filter(F.col("n") >= share * F.col("n_windows") - 1e-9).filter((F.size(own) == F.size("slots")) & (F.size(found) == F.size("slots")))


def short_leaks(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Items without windows, by all their words in a row. One hash join for each number of words."""
    def of(n: int) -> DataFrame:
        own = few.filter(F.col("n") == n).select("item_id", "words").distinct()
        words = rows.select("doc_id", "text_hash", lowered(raw_words(F.col("text"))).alias("low"))
        words = words.filter(F.size("low") >= n if n >= SHORTEST else F.size("low") == n)
        cut = let(F.col("low"), lambda low: F.transform(places(low, n), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(low, i + 1, n), " ").alias("words"))))
        met = words.select("doc_id", "text_hash", F.explode(cut).alias("x")).select("doc_id", "text_hash", "x.*").join(own, "words")
        met = met.groupBy("doc_id", "text_hash", "item_id").agg(F.min("at").cast("long").alias("first_word"))
        return met.select("doc_id", "text_hash", "item_id", F.lit(1.0).alias("share"), "first_word", F.lit(False).alias("changed"))

    return reduce(DataFrame.union, [of(r.n) for r in few.select("n").distinct().orderBy("n").collect()])


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs, with all columns, that leak no item. The leaking ones are broadcast up to ``most``, so that the texts needn't be shuffled."""
    bad = stored(leaks(docs, items, id_col, text_col, most=most).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct(), "leaks")
    bad = sent(bad, bad.count(), most)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(bad, F.col(f"row.`{id_col}`").eqNullSafe(F.col("d")) & (F.xxhash64(F.col(f"row.`{text_col}`")) == F.col("t")), "left_anti").select("row.*")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
