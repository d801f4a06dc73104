"""URL filter: allow and block rules, then a cascade of Bloom filters over the corpus's sites.

A table of listed keys (sites, that is the last three labels of a host) is given, from a blocklist say; the
query lists the corpus's sites by words in their names. A cascade's first level encodes the corpus's listed keys,
the next one the other keys that the first takes for listed, the next one the listed keys that this one takes for
others, and so on until no key is mistaken. Over the universe it was built from, a lookup is exact and needs no join:
the listed table is joined with the distinct keys only.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule; an
empty key is never listed; null, empty and repeated listed keys count once or not at all; keys that no page has play no part;
repeated rows are judged alike; an empty table gives an empty result; other columns of both tables play no part, whatever
their names; a url of any length is judged whole; of rules as long as each other the longer host, then the block, holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, columns, table

#: (verdict, host, path prefix) of the contract.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: A site is listed if one of the words between its dots and hyphens is among these.
LISTED_WORDS = (
    "adult", "ads", "adserver", "bet", "bets", "betting", "bingo", "casino", "casinos", "clickbait", "crack", "doorway", "escort", "escorts", "gambling", "hentai", "keygen", "lottery", "malware", "nude", "payday",
    "phishing", "pills", "poker", "popads", "porn", "porno", "roulette", "sex", "slots", "spam", "spammer", "torrent", "tracker", "viagra", "warez", "webcam", "xxx",
)
BITS_PER_KEY, HASHES, MAX_LEVELS = 8, 4, 40
#: Above so many bytes in the filters of all levels a cascade isn't sent out; build() refuses and listed_by_join() serves.
MAX_BYTES = 256 << 20
#: Words of a filter that are gathered in one array first.
SHARD = 1024


class TooLarge(Exception):
    """The filters would need more bytes than may be sent out."""


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of the url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def site_of(host: Column) -> Column:
    """The last three labels of the host, or all of it."""
    return F.substring_index(host, ".", -3)


def is_listed(site: Column, words: tuple[str, ...] = LISTED_WORDS) -> Column:
    return F.arrays_overlap(F.split(site, r"[-.]"), F.array(*[F.lit(w) for w in words]))


def deciding_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest rule that fits, else nulls. A rule fits its host and all subdomains."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, its_host, prefix in reversed(longest):
        fits = ((host == its_host) | host.endswith(f".{its_host}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(its_host + prefix)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


class BloomCascade:
    """levels: a one-row table of the filter's 64-bit words for each level, with the number of words."""

    def __init__(self, levels: list[tuple[DataFrame, int]]):
        self.levels = levels

    @staticmethod
    def _places(key: Column, level: int, words: int) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(level), F.lit(j), key), F.lit(words * 64)) for j in range(HASHES)]

    @classmethod
    def build(cls, universe: DataFrame, max_bytes: int = MAX_BYTES) -> BloomCascade:
        """universe: distinct ``key`` with ``listed`` true or false. Each level is counted, built and cut off by a checkpoint."""
        spark = universe.sparkSession
        universe = checkpointed(universe)
        levels: list[tuple[DataFrame, int]] = []
        encode, check, used = universe.filter("listed"), universe.filter("not listed"), 0
        while count := encode.count():
            if len(levels) >= MAX_LEVELS:
                raise ValueError(f"after {MAX_LEVELS} levels {count} keys are still mistaken")
            words = 1 << max(0, (count * BITS_PER_KEY - 1) // 64).bit_length()
            used += words * 8
            if used > max_bytes:
                raise TooLarge(f"the filters need over {max_bytes} bytes; use listed_by_join()")
            bit = F.explode(F.array(*cls._places(F.col("key"), len(levels), words))).alias("bit")
            by_word = encode.select(bit).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits"))
            every = spark.range(words).withColumnRenamed("id", "word").join(by_word, "word", "left").withColumn("shard", F.expr(f"word DIV {SHARD}"))
            shards = every.groupBy("shard").agg(F.expr("transform(array_sort(collect_list(struct(word, coalesce(bits, 0L) AS bits))), x -> x.bits)").alias("own"))
            row = shards.agg(F.expr("flatten(transform(array_sort(collect_list(struct(shard, own))), x -> x.own))").alias("bits"))
            levels.append((checkpointed(row), words))
            encode, check = check.filter(cls._passes(levels, len(levels) - 1, F.col("key"))), encode
        return cls(levels)

    @classmethod
    def _passes(cls, levels: list[tuple[DataFrame, int]], level: int, key: Column) -> Column:
        row, words = levels[level]
        bits = row.scalar()
        return reduce(Column.__and__, [F.getbit(F.element_at(bits, (F.shiftright(at, 6) + 1).cast("int")), (at % 64).cast("int")) == 1 for at in cls._places(key, level, words)])

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe: the first level that a key doesn't pass decides."""
        inside = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            inside = F.when(self._passes(self.levels, level, key), inside).otherwise(F.lit(level % 2 == 1))
        return F.coalesce(inside, F.lit(False))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, site, rule, ruled."""
    host, path = url_parts(F.col("url"))
    rows = columns(pages, page_id=id_col, url=url_col).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = deciding_rule(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", site_of(F.col("host")).alias("site"), rule.alias("rule"), verdict.alias("ruled"))


def keys_of(rows: DataFrame) -> DataFrame:
    """key: every site of the corpus once; partial sums before the shuffle take a hot site down to a row a task."""
    return rows.filter("site <> ''").select(F.col("site").alias("key")).distinct()


def universe_of(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """keys with ``listed``: whether the table of listed keys has them."""
    known = listed.select(F.col("key").alias("k")).filter("k <> ''").distinct().withColumn("listed", F.lit(True))
    return keys.join(known, F.col("key") == F.col("k"), "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))


def sites_with_words(keys: DataFrame, words: tuple[str, ...] = LISTED_WORDS) -> DataFrame:
    """Those of the keys that have one of the words in their names."""
    return keys.filter(is_listed(F.col("key"), words))


def listed_by_join(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """rows with ``listed``, for lists too large for filters: a left join on distinct keys, whose skew Spark splits."""
    found = listed.filter("listed").select(F.col("key").alias("site"), F.lit(True).alias("listed"))
    return rows.join(found, "site", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def filter_urls(pages: DataFrame, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", key_col: str = "key", rules=RULES, words: tuple[str, ...] = LISTED_WORDS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict, site, listed. The rule decides, else the cascade: sites in the table ``listed`` are blocked, without one those with listed words."""
    rows = judged(pages, id_col, url_col, rules)
    keys = checkpointed(keys_of(rows))
    known = sites_with_words(keys, words) if listed is None else columns(listed, key=key_col)
    universe = universe_of(keys, known)
    try:
        cascade = BloomCascade.build(universe, max_bytes)
        rows = rows.withColumn("listed", cascade.contains(F.col("site")) & (F.col("site") != ""))
    except TooLarge:
        rows = listed_by_join(rows, universe)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "site", "listed")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


_HOST = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = "(host = '{0}' OR suffix(host, '.{0}')) AND starts_with(path, '{1}')"
SQL = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), named AS (
  SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), sites AS (
  SELECT *, array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') AS site FROM named
), ruled AS (
  SELECT *, list_has_any(regexp_split_to_array(site, '[-.]'), [{", ".join(f"'{w}'" for w in LISTED_WORDS)}]) AND site <> '' AS listed,
    CASE WHEN {_FITS.format("example.net", "/de/8")} THEN 'example.net/de/8' WHEN {_FITS.format("example.com", "/en/7")} THEN 'example.com/en/7'
      WHEN {_FITS.format("com", "/en/")} THEN 'com/en/' WHEN {_FITS.format("net", "/de/")} THEN 'net/de/' WHEN {_FITS.format("org", "/es/")} THEN 'org/es/' END AS rule
  FROM sites
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/de/8', 'com/en/', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, site, listed
FROM ruled
"""
