"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from lexloom.llm import common, decontaminate, language, licenses, lines, pieces, quality, similar, simhash, surrogates, toxicity, url_filter
from lexloom.llm.common import crc_mod
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def docs(spark, texts, extra=True):
    """doc_id from 0, with columns whose names the operators use themselves."""
    rows = [(k, t, "en", "s", 1, "x", "y") for k, t in enumerate(texts)]
    names = ["doc_id", "text", "lang", "source", "n_chars"] + (["h", "fp"] if extra else [])
    return spark.createDataFrame([r[: len(names)] for r in rows], ", ".join(f"{n} {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


EDGE = [None, "", " \n\t", "a", "a b", "a b c", "a b c", "é" * 50, "x" * 20_000, "line one is here\nline one is here\n\nother"]


# --- 1

def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(spark):
    rng = random.Random(1)
    bits = ["GNU General", "public license", "GNU General Public License, version 3", "Apache License", "apache-license 2.0", "CC BY", "cc-by-nc 4.0", "MIT License", "mit", "license", "é", "\u00a0", "x1", "SPDX-License-Identifier: MIT"]
    texts = EDGE + ["".join(rng.choice(bits) + rng.choice([" ", ", ", "\n", "", "."]) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    rows = licenses.scan_licenses(docs(spark, texts)).collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows] == list(map(brute_base, texts))
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
    assert all(not (a is not b and b.first_word <= a.first_word and a.first_word + a.n_words <= b.first_word + b.n_words and (b.priority, -b.n_words) < (a.priority, -a.n_words)) for r in rows for a in r.detections for b in r.detections)
    assert licenses.scan(b"SPDX-License-Identifier: Apache-2.0")[2][0][0] == "apache-2.0"
    assert len(licenses.rules()) > 200
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def matches_of(pattern):
    """Texts that the pattern matches: each alternative and each option taken and left in turn, the others at their first."""
    from re import _constants as K
    from re import _parser as parser

    def first_and_more(node):
        op, arg = node
        if op is K.LITERAL:
            return [chr(arg)]
        if op is K.NOT_LITERAL:
            return ["x"]
        if op is K.IN:
            return [{K.CATEGORY: "7"}[arg[0][0]]] if arg[0][0] is K.CATEGORY and arg[0][1] is K.CATEGORY_DIGIT else ["x"] if arg[0][0] in (K.CATEGORY, K.NEGATE) else [chr(c) for k, c in arg if k is K.LITERAL] or [chr(arg[0][1][0])]
        if op in (K.MAX_REPEAT, K.MIN_REPEAT):
            least, _, inner = arg
            own = whole(inner)
            return [o * least for o in own[:1]] + [o * max(1, least) for o in own]
        if op is K.SUBPATTERN:
            return whole(arg[3])
        if op is K.BRANCH:
            return [x for each in arg[1] for x in whole(each)]
        return [""]

    def whole(nodes):
        parts = [first_and_more(n) for n in nodes]
        out = ["".join(p[0] for p in parts)]
        return out + ["".join(alt if k == j else p[0] for k, p in enumerate(parts)) for j, each in enumerate(parts) for alt in each[1:]]

    return whole(parser.parse(pattern))


def ungated(text):
    """What scan() finds, by trying every rule and holding every pair of detections against each other."""
    line = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
    hits = [(p, m.start() - m.end(), k, m.start(), m.end(), label) for k, (p, label, _, pattern) in enumerate(licenses.rules()) for m in re.finditer(f"(?<!\\S)(?:{pattern})(?!\\S)", line)]
    kept = []
    for h in sorted(hits):
        if not any(g[3] <= h[3] and h[4] <= g[4] for g in kept):
            kept.append(h)
    return [(label, k, line.count(" ", 0, a), line.count(" ", a, b) + 1, p) for p, _, k, a, b, label in sorted(kept, key=lambda h: (h[3], h[4], h[2]))]


def test_every_rule_finds_what_its_pattern_matches():
    rng = random.Random(12)
    every = [(k, m) for k, (_, _, _, pattern) in enumerate(licenses.rules()) for m in matches_of(pattern)]
    assert {k for k, _ in every} == set(range(len(licenses.rules()))) and len(every) > 400
    for k, m in every:
        assert licenses.rules()[k][2] in " ".join(m.split()), (k, m)
        text = f"Before, {m.title()}; after"
        assert licenses.scan(text.encode())[2] == ungated(text) != []
    for k in range(300):
        text = " ".join(rng.choice(every)[1] if rng.random() < 0.6 else rng.choice(["and", "license", "version 2.0", "the", "or later"]) for _ in range(rng.randint(1, 9)))
        assert licenses.scan(text.encode())[2] == ungated(text)
    for other in ("permission granted by the mayor", "a driving licence under review", "apache helicopter", "the mit campus", "gnu herds", "copyright law", "open source code"):
        assert licenses.scan(other.encode())[2] == ungated(other) == []


# --- 2

QUESTION = "Alice has 12 apples and buys 7 more at the market. Bob gives her 3 pears for two of them. How many pieces of fruit does Alice carry home now, and how many kg is that at 150 g each?"


def test_decontamination(spark):
    rng = random.Random(2)
    items = ["A train with 12 cars leaves Paris for Rome at 7 km per hour and Alice counts 40 seats in each of the cars she sees today", prose(rng, 30), "too short", None, prose(rng, 12) + ".\nNext " + prose(rng, 12), QUESTION, "seven pears ripen slowly"]
    train = items[0]
    texts = [None, "", prose(rng, 200), f"{prose(rng, 50)} {items[1]} {prose(rng, 40)}", train.replace("12", "31").replace("Alice", "Bob").replace("40", "8"), train.replace("Alice", "Bob").replace("Paris", "Bob"), f"x.\n{items[4]}", items[1][: len(items[1]) // 2], items[1].upper()]
    texts += [train.lower(), train.upper(), train.replace("Alice", "Mary Ann"), QUESTION.replace("Alice", "Carol").replace("Bob", "Dave"), QUESTION.replace("two", "one").replace("12", "twenty five"), QUESTION.replace("at the market", "at the weekly market"), "We learn: Seven pears ripen slowly, they say.", "too short", "far too short", f"and so on {QUESTION} and more", QUESTION.replace("3 pears", "5 pears").replace("7 more", "5 more")]
    bench = spark.createDataFrame([(k, t, "d", "t") for k, t in enumerate(items)], "item_id long, text string, doc_id string, hash string")
    want = {(3, 1), (4, 0), (6, 4), (8, 1), (9, 0), (10, 0), (11, 0), (12, 5), (13, 5), (14, 5), (15, 6), (16, 2), (18, 5)}
    for most in (decontaminate.BROADCAST_ROWS, 0):
        found = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs(spark, texts), bench, most=most).collect()}
        assert set(found) == want
        assert {p for p in want if found[p].changed} == {(4, 0), (11, 0), (12, 5), (13, 5)} and found[3, 1].first_word == 50
    more = docs(spark, texts).withColumns({c: F.lit(1) for c in ("__id", "d", "t", "item_id", "a.b")})
    kept = decontaminate.drop_leaks(more, bench)
    assert kept.columns == more.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(texts))) - {d for d, _ in want})
    assert decontaminate.leaks(docs(spark, texts), bench.limit(0)).count() == 0 and decontaminate.leaks(docs(spark, []), bench).count() == 0
    twice = docs(spark, texts[3:5]).union(docs(spark, texts[3:5])).withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted((r.item_id, r.share) for r in decontaminate.leaks(twice, bench).collect()) == [(0, 1.0), (1, 1.0)]
    assert decontaminate.leaks(docs(spark, [(prose(rng, 60_000) + " " + QUESTION)]), bench).count() == 1


def plain_template(text, only, both, words):
    """(template words, values) of a text, from the rules."""
    text = re.sub(r"(?<=\d)[.,:/](?=\d)", "", text or "")
    raw = [w for w in re.sub(r"[^\w¶]+|_|(?<=\d)(?=[^\W\d_])", " ", re.sub(r"[.!?:\n]", "¶", text)).split(" ") if w.strip("¶")]
    out = []
    low = [w.strip("¶").lower() for w in raw]
    number = lambda w: w[0].isdigit() or w in decontaminate.NUMBER_WORDS
    for k, (w, x) in enumerate(zip(raw, low, strict=True)):
        own, first = w.strip("¶"), k == 0 or raw[k - 1].endswith("¶")
        cap = len(own) > 1 and own[0] != x[0] and own[1] == x[1]
        kind = "§d" if number(x) else "§u" if k and x in decontaminate.UNITS and number(low[k - 1]) else "§n" if x in only or cap and x not in words and not (first and x in both) else x
        if out and kind in ("§n", "§d") and out[-1][0] == kind:
            out[-1][1].append(x)
        else:
            out.append([kind, [x]])
    return [k for k, _ in out], [" ".join(v) for _, v in out]


def plain_leaks(texts, items):
    seen = {}
    for t in items:
        raw = [w for w in re.sub(r"[^\w¶]+|_|(?<=\d)(?=[^\W\d_])", " ", re.sub(r"[.!?:\n]", "¶", re.sub(r"(?<=\d)[.,:/](?=\d)", "", t))).split(" ") if w.strip("¶")]
        for k, w in enumerate(raw):
            own, x = w.strip("¶"), w.strip("¶").lower()
            cap = len(own) > 1 and own[0] != x[0] and own[1] == x[1]
            s = seen.setdefault(x, set())
            s |= {"word"} if not cap else {"name", "inner"} if k and not raw[k - 1].endswith("¶") else {"name"}
    only, both, words = {x for x, s in seen.items() if "word" not in s and s}, {x for x, s in seen.items() if {"inner", "word"} <= s}, {x for x, s in seen.items() if "word" in s and "inner" not in s}

    def windows(t):
        c, v = plain_template(t, only, both, words)
        return [(k, tuple(c[k : k + 5]), v[k : k + 5]) for k in range(len(c) - 4) if sum(not w.startswith("§") for w in c[k : k + 5]) >= 2]

    found = set()
    for i, item in enumerate(items):
        own = windows(item)
        for d, t in enumerate(texts):
            starts = {}
            for place, w, v in windows(t):
                for at, x, o in own:
                    if w == x:
                        start, reach = place - at, max(2, int(len(own) * (1 - 0.8)))
                        for where in ((0, start), (1, start // (2 * reach)), (2, (start + reach) // (2 * reach))):
                            ats, slots = starts.setdefault(where, (set(), set()))
                            ats.add(at)
                            slots |= {(a, b) for k, a, b in zip(w, o, v, strict=True) if k.startswith("§")}
            if any(len(a) >= 0.8 * len(own) - 1e-9 and len({x for x, _ in s}) == len(s) == len({y for _, y in s}) for a, s in starts.values()):
                found.add((d, i))
    return found


def test_decontamination_against_plain(spark):
    rng = random.Random(13)
    given = ["Alice", "Bob", "Mary Ann", "Carol", "May"]

    def sentence():
        return " ".join(rng.choice([rng.choice(WORDS), rng.choice(WORDS), rng.choice(WORDS), rng.choice(given), str(rng.randint(1, 99)), rng.choice(["two", "may", "5 km"])]) for _ in range(rng.randint(6, 14))).capitalize() + "."

    items = [" ".join(sentence() for _ in range(rng.randint(1, 3))) for _ in range(12)]
    texts = []
    for _ in range(120):
        own = rng.choice(items).split(" ")
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(own))
            own[k] = rng.choice([rng.choice(WORDS), rng.choice(given), str(rng.randint(1, 99)), own[k], ""])
        texts.append(rng.choice(["", sentence() + " "]) + rng.choice([str, str, str.lower, str.upper])(" ".join(own)) + rng.choice(["", " " + sentence()]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    assert got == plain_leaks(texts, items) and 20 < len(got) < 120


def test_decontamination_sorts_out_by_words(spark, monkeypatch):
    rng = random.Random(31)
    odd = "L'été où la KelvinK çà «garçon» naïve x9y 5kilos óu ÉCOLE straße ΣΑΣ"
    items = [f"{prose(rng, 3)} {odd} {prose(rng, 20)}", "Σας λέω ότι όλα είναι εντάξει εδώ σήμερα", f"{prose(rng, 8)} 5 km {prose(rng, 8)}", QUESTION]
    near = [items[0].upper(), items[0].lower(), items[0].replace(" ", " -- ").replace("naïve", "nouveau"), items[1], items[2].replace(" ", ", "), f"<<{QUESTION}>>"]
    texts = [None, "", *near, *(f"x {t} 7" for t in near), *(prose(rng, 60) for _ in range(20)), *(" ".join(f"word{k}" for k in range(j, j + 50)) for j in range(9))]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = []
    for bench in (table, table.filter("item_id <> 1")):  # one of the items has no plain words
        for most in (decontaminate.FILTER_KEYS, 0):
            monkeypatch.setattr(decontaminate, "FILTER_KEYS", most)
            got.append({tuple(r) for r in decontaminate.leaks(docs(spark, texts), bench).collect()})
        monkeypatch.undo()
    assert got[0] == got[1] and got[2] == got[3] and {r[2] for r in got[0]} == {0, 1, 2, 3} and len(got[2]) >= 8
    keys = spark.createDataFrame([(["gamma", "kilos"],), (["apples", "fruit"],)], "words array<string>")
    rows = spark.createDataFrame([(t,) for t in ("Gamma, 5Kilos", "gamma kiloss", "FRUIT.apples", "fruit", None, "")], "text string")
    assert [r.text for r in decontaminate.holding(rows, keys, 9).collect()] == ["Gamma, 5Kilos", "FRUIT.apples"]
    assert decontaminate.holding(rows, keys, 1).count() == 6 and decontaminate.holding(rows, keys.limit(0), 9).count() == 0


def test_drop_leaks_leaves_texts_where_they_are(spark):
    """However large the leaking rows' ids are for Spark's own bound, the texts aren't shuffled to drop them."""
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        bench = spark.createDataFrame([(0, QUESTION)], "item_id long, text string")
        kept = {most: decontaminate.drop_leaks(docs(spark, ["a b", QUESTION, None]), bench, most=most) for most in (decontaminate.BROADCAST_ROWS, 0)}
        assert [sorted(r.doc_id for r in x.collect()) for x in kept.values()] == [[0, 2]] * 2
        assert "SortMergeJoin" not in kept[decontaminate.BROADCAST_ROWS]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)


# --- 3

def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.COM/en/7x", "http://b.example.com/en/8", "http://example.net/de/81?q", "http://n.example.net/de/9", "http://x.org/es/", "http://free-bets.example.org/fr/1", "http://casino.io", "http://xcasino.io", "a://b://c/d", "http://com/en/1#x", "http://telecom/en/"]
    pages = spark.createDataFrame([(k, u, "h", "k") for k, u in enumerate(urls * 2)], "page_id long, url string, host string, key string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).orderBy("page_id").collect()]
    want = [("", "", None, "allow")] * 4 + [("a.example.com", "/en/7x", "example.com/en/7", "allow"), ("b.example.com", "/en/8", "com/en/", "block"), ("example.net", "/de/81", "example.net/de/8", "block"), ("n.example.net", "/de/9", "net/de/", "allow"), ("x.org", "/es/", "org/es/", "block"), ("free-bets.example.org", "/fr/1", None, "block"), ("casino.io", "", None, "block"), ("xcasino.io", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("com", "/en/1", "com/en/", "block"), ("telecom", "/en/", None, "allow")]
    assert got == want * 2
    assert [r.verdict for r in url_filter.filter_urls(pages, max_bytes=1).orderBy("page_id").collect()] == [w[3] for w in want * 2]
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    given = spark.createDataFrame([("xcasino.io", 1), ("xcasino.io", 2), (None, 3), ("", 4), ("b:", 5), ("elsewhere.org", 6)], "key string, listed int").withColumn("site", F.lit("s"))
    for most in (url_filter.MAX_BYTES, 1):
        rows = url_filter.filter_urls(pages.withColumns({"site": F.lit(1), "listed": F.lit(2), "verdict": F.lit(3)}), given, max_bytes=most)
        assert {r.site for r in rows.filter("listed").collect()} == {"xcasino.io", "b:"}
        assert [r.verdict for r in rows.filter("rule is null").orderBy("page_id", "host").select("verdict").collect()].count("block") == 4
    long = spark.createDataFrame([(1, "http://a.org/" + "p/" * 50_000 + "?q")], "page_id long, url string")
    assert len(url_filter.filter_urls(long).first().path) == 100_001


def test_open_levels_are_no_size_problem(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_LEVELS", 0)
    pages = spark.createDataFrame([(1, "http://casino.io/")], "page_id long, url string")
    with pytest.raises(ValueError, match="levels"):
        url_filter.filter_urls(pages)


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("key"), F.col("id").cast("string")).alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filter.BloomCascade.build(universe)
    assert len(cascade.levels) > 2
    assert universe.filter(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


# --- 4

def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    inside = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    own = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(own) - len(set(own)), len(inside)


def test_quality(spark):
    rng = random.Random(4)
    texts = EDGE + ["".join(rng.choice(["a", "b ", "c\n", "é ", "#", " | ", "\u00a0", "\x0b", "\x1c"]) for _ in range(rng.randint(0, 200))) for _ in range(150)] + [prose(rng, 400), " ".join(["same"] * 90)]
    rows = quality.measure_quality(docs(spark, texts)).collect()
    assert [tuple(r[1:6]) for r in rows] == list(map(brute_quality, texts))
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    kept = quality.keep_good(docs(spark, texts))
    assert kept.columns == docs(spark, texts).columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}
    assert quality.measure_quality(docs(spark, [])).count() == 0
    assert quality.measure_quality(docs(spark, ["a"]).drop("lang", "source")).first().band == "latin"


def brute_measures(text):
    """(chars per token, tokens per word, byte share, entropy, top share, chars per byte-level token), each word encoded by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{quality.TOKENIZERS}/{quality.MODEL}")
    other = quality._byte_level(f"{quality.TOKENIZERS}/{quality.BYTE_MODEL}")
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    ids = [t for w in words for t in model.encode(w)]
    n, chars = max(len(ids), 1), sum(map(len, words))
    shares = [ids.count(t) / n for t in set(ids)]
    return chars / n, len(ids) / max(len(words), 1), sum(model.is_byte(t) for t in ids) / n, -sum(x * np.log2(x) for x in shares), max(shares, default=0), chars / max(sum(len(other.encode_ordinary(f" {w}")) for w in words), 1)


def test_quality_measures(spark):
    rng = random.Random(41)
    texts = EDGE + [prose(rng, 80), "Ünïcode 日本語 😀 words " * 20, "\ue000 \ue001" * 30, "don't it's 12,5 a-b_c " * 10]
    for r, t in zip(quality.measure_quality(docs(spark, texts)).collect(), texts, strict=True):
        assert (r.chars_per_token, r.tokens_per_word, r.byte_share, r.entropy, r.top_share, r.chars_per_byte_level_token) == pytest.approx(brute_measures(t))
    more = docs(spark, texts).withColumns({"a.b": F.lit(1), "n_words": F.lit("x"), "kept": F.lit(2)})
    assert quality.keep_good(more).columns == more.columns


def test_quality_bands_are_fitted(spark):
    """The bands are those of the training part of sf0.1; figures on the rest."""
    own, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    known = own.join(labels.select("doc_id"), "doc_id", "left_semi")
    assert quality.fit_bands(known, labels) == {k: v for k, v in quality.BANDS.items() if len(k) == 2}
    rest = quality.measure_quality(known.filter(crc_mod(F.col("doc_id"), 4) == 2)).join(labels, "doc_id").filter("not base_failed")
    by = {r.quality: r.k for r in rest.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert by[1] > 0.99 and by[0] < 0.05


# --- 5 and 6

def test_language(spark):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(sf).join(sf.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.97
    same = sf.withColumn("lang", F.when(crc_mod(F.col("doc_id"), 4) != 2, F.col("lang")))
    assert language.identify(same).select("doc_id", "lang_pred", "score").exceptAll(language.identify(sf).select("doc_id", "lang_pred", "score")).count() == 0
    odd = docs(spark, [*EDGE, "12 34 !"])
    got = language.identify(odd).collect()
    assert [r.lang_pred for r in got][:3] == ["und"] * 3 and got[-1].lang_pred == "und"
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(odd.limit(0)).count() == 0
    code = language.codewords(9)
    assert min((code[a] != code[b]).sum() for a, b in itertools.combinations(range(9), 2)) >= 8


def plain_language(train, text):
    """(language, score) from the definition, trigram by trigram."""
    import math

    def grams(t):
        raw = b" " + t.lower().encode("utf-8", "replace").translate(language.LETTERS) + b" "
        return [((raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - language.BUCKETS_LOG2 for k in range(len(raw) - 2)]

    if not text or not re.search(r"[^\W\d_]", text):
        return "und", 0.0
    counts = {}
    for t, lang in train:
        if t is not None and lang is not None:
            for g in grams(t):
                counts.setdefault(lang, {}).setdefault(g, 0)
                counts[lang][g] += 1
    langs = sorted(counts)
    code = language.codewords(len(langs))
    own = grams(text)
    share = [{g: n / sum(c.values()) for g, n in c.items()} for c in map(counts.get, langs)]
    every = {g for c in counts.values() for g in c} | set(own)
    margins, worth = [], []
    for j in range(code.shape[1]):
        yes, no = ([share[k] for k in range(len(langs)) if code[k, j] == b] for b in (1, -1))
        p = {g: sum(s.get(g, 0) for s in yes) / len(yes) + language.SMOOTHING for g in every}
        q = {g: (sum(s.get(g, 0) for s in no) / len(no) if no else 1 / language.BUCKETS) + language.SMOOTHING for g in every}
        margins.append(sum(math.log(p[g] / q[g]) for g in own) / len(own))
        worth.append(sum((p[g] - q[g]) * math.log(p[g] / q[g]) for g in every))
    loss = [sum(w / sum(worth) * math.log1p(math.exp(-max(-50, min(50, language.SHARPNESS * c * m)))) for c, m, w in zip(row, margins, worth, strict=True)) for row in code.tolist()]
    near = [math.exp(min(loss) - x) for x in loss]
    best = loss.index(min(loss))
    return langs[best], near[best] / sum(near)


def test_language_against_plain(spark, monkeypatch):
    rng = random.Random(51)
    letters = {"aa": "abcde ", "bb": "cdefg ", "cc": "efghi ", "dd": "abghé ", "ee": "xyzab ", "ff": "klmno "}
    monkeypatch.setattr(language, "HELD", 2)
    for n in (2, 6):
        train = [("".join(rng.choices(letters[lang], k=60)), lang) for lang in list(letters)[:n] for _ in range(4)] + [(None, "aa"), ("abc", None)]
        train += train[:2]
        book = language.learn(spark.createDataFrame(train, "text string, lang string").repartition(3))
        for text in [None, "", "12 3", "abab", "é", "gh" * 30, *["".join(rng.choices("abcdefghixyz é", k=50)) for _ in range(30)]]:
            lang, score, *_ = book.decode(text)
            assert (lang, score) == (plain_language(train, text)[0], pytest.approx(plain_language(train, text)[1], abs=1e-5))
    few = language.learn(spark.createDataFrame([("abc" * (k + 1), f"l{k:02}") for k in range(20)], "text string, lang string"), languages=5)
    assert few.langs == [f"l{k}" for k in range(15, 20)]


def test_toxicity(spark):
    rng = random.Random(6)
    texts, marks = [], []
    for k in range(900):
        toxic = k % 3 == 0
        own = [rng.choice(WORDS) for _ in range(60)]
        for _ in range(4 * toxic):
            own[rng.randrange(60)] = rng.choice(["wretch", "vermin", "filth"])
        texts.append(" ".join(own))
        marks.append((k, int(toxic)))
    labels = spark.createDataFrame([*marks, (0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs(spark, texts), labels).collect()}
    held = [k for k in rows if rows[k].held_out]
    assert set(held) == {k for k in range(900) if zlib.crc32(str(k).encode()) % 3 == 1}
    assert np.mean([rows[k].predicted == marks[k][1] for k in held]) > 0.97
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows.values())
    odd = toxicity.score_toxicity(docs(spark, EDGE), labels.limit(0)).collect()
    assert len(odd) == len(EDGE) and {r.score for r in odd} == {0.0}
    shuffled = toxicity.score_toxicity(docs(spark, texts), labels, broadcast_rows=0).collect()
    assert {r.doc_id: r.score for r in shuffled} == {k: r.score for k, r in rows.items()}
    joined = toxicity.score_toxicity(docs(spark, texts), labels.withColumns({"text": F.lit("x"), "held_out": F.lit(1)}), broadcast_entries=0).collect()
    assert {r.doc_id: r.score for r in joined} == pytest.approx({k: r.score for k, r in rows.items()})
    changed = labels.withColumn("toxic", F.when(crc_mod(F.col("doc_id"), 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.score_toxicity(docs(spark, texts), changed).collect()} == {k: r.score for k, r in rows.items()}


def plain_ratio(train, text):
    """The largest mean over passages and the mean over all, from the definition, with words themselves instead of hashes."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    triples = ({}, {})
    for t, toxic in train:
        w = ["", "", *split(t)]
        for a, b, c in zip(w, w[1:], w[2:], strict=False):
            triples[toxic > 0].setdefault((b, c), set()).add(a)
    pairs = [{p: len(s) for p, s in t.items()} for t in triples]
    words = [{}, {}]
    for c in (0, 1):
        for _, w in pairs[c]:
            words[c][w] = words[c].get(w, 0) + 1

    def lift(counts, key):
        both = [c.get(key, 0) for c in counts]
        if sum(both) < 2:
            return 0.0, 0.0
        out = []
        for c in (0, 1):
            once, twice = (sum(v == k for v in counts[c].values()) for k in (1, 2))
            d = once / (once + 2 * twice) if once else 0.5
            out.append(max(both[c] - d, 0) / sum(counts[c].values()) / (sum(both) / sum(sum(x.values()) for x in counts)))
        return tuple(out)

    own = ["", *split(text)]
    each = []
    for u, w in zip(own, own[1:], strict=False):
        of_word, of_pair = lift(words, w), lift(pairs, (u, w))
        logs = [np.log(toxicity.PAIR_BACK * (toxicity.WORD_BACK + (1 - toxicity.WORD_BACK) * of_word[c]) + (1 - toxicity.PAIR_BACK) * of_pair[c]) for c in (0, 1)]
        each.append(logs[1] - logs[0])
    n = min(toxicity.PASSAGE, len(each))
    return (max(np.mean(each[k : k + n]) for k in range(len(each) - n + 1)), np.mean(each)) if each else (0.0, 0.0)


@pytest.mark.parametrize("most", [toxicity.BROADCAST_ENTRIES, 0])
def test_kneser_ney_ratios(spark, most):
    rng = random.Random(7)
    train = [(" ".join(rng.choice("abcdefgh" if toxic else "abcdefxyz") for _ in range(rng.randint(0, 30))), toxic) for toxic in rng.choices([0, 1], k=60)]
    train += [train[0], (None, 1), ("", 0), ("lone", 1)]
    model = toxicity.learn(spark.createDataFrame(train, "text string, toxic int").repartition(3), most)
    texts = [None, "", "a", "a b", "new words only", *[t for t, _ in train[:10]], "A h, H g g! x y z " * 40, "a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.ratio, r.text_ratio) for r in toxicity.ratios(rows, model, "doc_id").collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k] == pytest.approx(plain_ratio(train, t), abs=1e-6)


# --- 7

def test_surrogates(spark):
    text = "Mr John Smith (john.smith@mail.org, JOHN.SMITH@MAIL.ORG) rang +1 (523) 555-7040, again +1 523 555 7040; Mrs Anna O'Neil paid 4111 1111 1111 1111 and GB82 WEST 1234 5698 7654 32 from 203.0.113.9, not 10.0.0.7. Token = \"0c497b5014f705c0be648d68b816f88c209136eb\". 078-05-1120. John Smith left."
    new, said = surrogates.replaced(text, b"k")
    assert {k for k, _, _ in said} == {"person", "email", "phone", "card", "iban", "ip", "secret", "ssn"}
    assert all(a not in new for _, a, _ in said)
    by = {a: b for _, a, b in said}
    assert by["JOHN.SMITH@MAIL.ORG"] == by["john.smith@mail.org"].upper()
    assert re.sub(r"\D", "", by["+1 (523) 555-7040"]) == re.sub(r"\D", "", by["+1 523 555 7040"])
    assert surrogates.luhn_sum([int(c) for c in by["4111 1111 1111 1111"] if c.isdigit()]) % 10 == 0 and surrogates._valid_iban(by["GB82 WEST 1234 5698 7654 32"])
    assert by["10.0.0.7"].startswith("10.") and not surrogates._private([int(x) for x in by["203.0.113.9"].split(".")])
    assert by["John Smith"].split()[0].lower() in surrogates.GIVEN["m", "latin"] and by["Anna O'Neil"].split()[0].lower() in surrogates.GIVEN["f", "latin"]
    assert surrogates.replaced(text, b"other")[0] != new
    texts = [text, text, *EDGE]
    rows = surrogates.pseudonymise(docs(spark, texts).withColumns({"row": F.lit(1), "originals": F.lit("x"), "clashes": F.lit(2)}), b"k").orderBy("doc_id").collect()
    assert rows[0].text == rows[1].text == new and rows[2].text is None and [r.text for r in rows[3:]] == texts[3:]
    assert surrogates.collisions(docs(spark, texts), b"k").count() == 0 and surrogates.pseudonymise(docs(spark, []), b"k").count() == 0
    assert {r.clashes for r in rows} == {0}
    taken = surrogates.replaced("write to jo@x.org", b"k")[0]
    clash = surrogates.pseudonymise(docs(spark, ["write to jo@x.org", taken, "none"]), b"k").orderBy("doc_id").collect()
    assert [r.clashes for r in clash] == [1, 0, 0]


@pytest.mark.parametrize(
    ("text", "gone", "kept"),
    [
        ("Mr John Smith replied; Smith agreed.", ["John", "Smith"], ["Mr", "replied", "agreed"]), ("Call +1 523 555 7040 or 523-555-7040.", ["523"], ["+1"]), ("Then Priya Raman replied.", ["Priya", "Raman"], ["replied"]), ("signed by Priya Raman", ["Raman"], []),
        ("ο Γεώργιος Παπάς έφυγε", ["Γεώργιος", "Παπάς"], ["έφυγε"]), ("He lives at 12 Castle Street now", ["12", "Castle"], ["Street"]), ("in der Hauptstraße 17 dort", ["Haupt", "17"], ["straße"]), ("She was born on 3 May 1980.", ["3 May 1980"], []), ("dob: 1980-05-03", ["1980-05-03"], ["19"]),
        ("from 2001:db8:85a3::8a2e:370:7334 came", ["85a3", "7334"], ["2001:"]), ("Call 020 7946 0018 or +44 20 7946 0018", ["7946"], ["+44"]), ("Mr Be said so", [" Be "], ["Mr"]), ("The New York Bank said no", [], ["New York Bank"]), ("In May Day said", [], ["May Day"]),
    ],
)
def test_surrogate_probes(text, gone, kept):
    new, said = surrogates.replaced(text, b"k")
    assert all(g not in new for g in gone) and all(k in new for k in kept), new
    assert len(text) == len(new) or any(k == "date" for k, _, _ in said) or "person" in {k for k, _, _ in said}


def test_surrogates_agree_across_spellings():
    by = {a: b for _, a, b in surrogates.replaced("+1 523 555 7040, 523-555-7040, 020 7946 0018, +44 20 7946 0018, Mr Ian Smith and Smith", b"k")[1]}
    number = lambda t: surrogates.phone_parts(t)[1]
    assert number(by["+1 523 555 7040"]) == number(by["523-555-7040"]) and number(by["020 7946 0018"]) == number(by["+44 20 7946 0018"])
    assert by["Ian Smith"].endswith(f" {by['Smith']}")


def test_surrogates_over_a_corpus(spark):
    """Brute force over sf0.001: what was found is gone, one surrogate for one entity, none its own, formats kept."""
    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows, given = {r.doc_id: r for r in surrogates.pseudonymise(own, b"k").collect()}, {r.doc_id: r.text for r in own.collect()}
    there, back = {}, {}
    for k, text in given.items():
        at, out = 0, []
        for a, b, kind, rule in surrogates.entities(text or ""):
            new = surrogates.RULES[rule][3](text[a:b], b"k")
            there.setdefault((kind, surrogates.canonical(kind, text[a:b])), set()).add(surrogates.canonical(kind, new))
            back.setdefault((kind, surrogates.canonical(kind, new)), set()).add(surrogates.canonical(kind, text[a:b]))
            assert new != text[a:b] and (kind in ("person", "date") or [c.isdigit() for c in new] == [c.isdigit() for c in text[a:b]] or kind in ("iban", "secret", "ip"))
            out += [text[at:a], new]
            at = b
        assert rows[k].text == "".join([*out, (text or "")[at:]]) if text is not None else rows[k].text is None
    assert len(there) > 10 and {len(v) for v in there.values()} == {1} == {len(v) for v in back.values()}


def test_permutations_are_one_to_one():
    for radix in ([10, 10, 10], [5, 21, 10], [7], [2, 2, 2, 2, 3]):
        every = list(itertools.product(*map(range, radix)))
        assert len({tuple(surrogates.permute(list(x), radix, b"k", "t")) for x in every}) == len(every)
    names = ["".join(x) for x in itertools.product("abe", "bcdst", "aeio", "nrt")]
    assert len({surrogates._name(n, b"k") for n in names}) == len(names)
    assert len({surrogates._ip(f"{a}.{b}.1.1", b"k") for a in range(256) for b in range(0, 256, 5)}) == 256 * 52


# --- 8

def brute_components(texts):
    prints = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        runs = [w] if len(w) < 3 else [w[k : k + 3] for k in range(len(w) - 2)]
        h = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [f"{p:016x}" for p in prints], [find(k) for k in range(len(texts))]


def test_simhash(spark):
    rng = random.Random(8)
    base = prose(rng, 300).split()
    near = [" ".join([*base[: rng.randrange(300)], rng.choice(WORDS), *base[rng.randrange(290) :]]) for _ in range(20)]
    slight = [" ".join(w if k != j else "omega" for k, w in enumerate(base)) for j in rng.sample(range(300), 60)]
    texts = EDGE + near + slight + ["A B c", "a  b\nC"] + [prose(rng, 5) for _ in range(20)]
    prints, roots = brute_components(texts)
    got = {r.doc_id: r for r in simhash.link(docs(spark, texts)).collect()}
    assert [got[k].fingerprint for k in range(len(texts))] == prints and [got[k].component_id for k in range(len(texts))] == roots
    kept = simhash.keep_one(docs(spark, texts))
    assert kept.columns == docs(spark, texts).columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(roots))
    assert simhash.link(docs(spark, [])).count() == 0
    odd = docs(spark, ["x y z", "x y z"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.component_id for r in simhash.link(odd).collect()] == [None, None] and simhash.keep_one(odd).count() == 1
    twice = docs(spark, ["x y z"])
    assert simhash.keep_one(twice.union(twice)).count() == 1


def test_keep_one_takes_all_columns(spark):
    more = docs(spark, ["x y z", "x y z", "other"]).withColumns({"__id": F.lit(1), "d": F.lit(2), "row": F.lit(3), "a.b": F.lit(4), "m": F.create_map(F.lit("k"), F.lit(1)), "s": F.struct(F.create_map(F.lit("k"), F.lit(1)).alias("m"))})
    kept = simhash.keep_one(more.union(more))
    assert kept.columns == more.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]


@pytest.mark.parametrize("hot", [1, 5, 1000])
def test_with_values(spark, hot):
    rng = random.Random(52)
    rows = [(k, rng.choice([1, 1, 1, 2, 3, 4, 5, None])) for k in range(60)]
    values = {1: "a", 2: None, 3: "c", 9: "x"}
    got = common.with_values(spark.createDataFrame(rows, "n long, k long"), spark.createDataFrame(list(values.items()), "k long, v string"), "k", hot)
    assert sorted((r.n, r.k or 0, r.v or "") for r in got.collect()) == sorted((n, k or 0, values.get(k) or "") for n, k in rows)


def test_keep_one_goes_by_texts(spark):
    rng = random.Random(21)
    texts = [prose(rng, 40) for _ in range(6)]
    nameless = docs(spark, [*texts, texts[0]]).withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r.text for r in simhash.keep_one(nameless).collect()) == sorted(texts)
    shared = docs(spark, texts).withColumn("doc_id", F.lit(7).cast("long")).union(docs(spark, texts[:1]))
    assert sorted(r.text for r in simhash.keep_one(shared).collect()) == sorted(texts)


def brute_similar(texts):
    """The least place that each text reaches over pairs of similarity 0.8 or more of five-word shingles."""
    sets = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    return root


def near_texts(rng):
    """Copies with edits at about the threshold, chains of them, a crowd around one text, and a passage that many quote."""
    texts = [None, "", "a b", "A  b", "a b c d e", "a b c d e f"]
    quoted = prose(rng, 40)
    for _ in range(12):
        words = prose(rng, rng.randint(20, 150)).split()
        for _ in range(6):
            texts.append(" ".join(words))
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
    crowd = prose(rng, 120).split()
    for k in range(40):
        at = rng.randrange(110)
        texts.append(" ".join(crowd[:at] + [f"w{k}"] + crowd[at + k % 7 :]))
    texts += [f"{prose(rng, 30)} {quoted} {prose(rng, 30)}" for _ in range(40)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("hot", [4, 10_000])
def test_similar_classes(spark, hot):
    texts = near_texts(random.Random(22))
    got = {r.doc_id: r.root for r in similar.classes(docs(spark, texts), hot=hot).collect()}
    want = brute_similar(texts)
    least = {}
    for k in range(len(texts)):
        least.setdefault(got[k], k)
    assert [least[got[k]] for k in range(len(texts))] == want and len(set(want)) > 50


def test_near_dedup_links_by_simhash(spark, monkeypatch):
    """The step's links are those pairs within two bits that are alike; the exact join meets no pair within a class of theirs."""
    rng = random.Random(41)
    texts = [None, "", "a b"]
    for _ in range(6):
        words = prose(rng, 400).split()
        for _ in range(8):
            texts.append(" ".join(words))
            words[rng.randrange(len(words))] = rng.choice(WORDS)
    rows = {}
    for t in texts:
        own = similar.shingles((t or "").encode())
        if len(own):
            bits = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in own) > len(own))
            rows[similar.print_of(own)] = (bits, set(own.tolist()))
    first = {}
    for fp, (bits, _) in sorted(rows.items()):
        first.setdefault(bits, fp)
    met = {(first[bits], fp) for fp, (bits, _) in rows.items() if fp != first[bits]} | {tuple(sorted((first[x], first[y]))) for x, y in itertools.combinations(first, 2) if (x ^ y).bit_count() <= 2}
    alike = lambda a, b: len(rows[a][1] & rows[b][1]) >= 0.8 * len(rows[a][1] | rows[b][1])
    want = {(a, b) for a, b in met if alike(a, b)}
    seen = []
    plain = similar.verified

    def noted(pairs, *rest):
        out = plain(pairs, *rest)
        seen.append(({tuple(r) for r in pairs.collect()}, {tuple(r) for r in out.collect()}))
        return out

    monkeypatch.setattr(similar, "verified", noted)
    assert len({r.root for r in similar.classes(docs(spark, texts)).collect()}) == len(set(brute_similar(texts)))
    assert seen[0] == (met, want) and len(want) > 10 and not want & set().union(*(x for x, _ in seen[1:]))


def test_few_links_are_closed_on_the_driver(spark, monkeypatch):
    """Near-dedup of a small table goes without rounds of joins; beyond the bound on links these give the same roots."""
    rng = random.Random(42)
    pairs = [(rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(60)] + [(k, k + 1) for k in range(100, 160)]
    pairs = sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})
    up = {x: x for p in pairs for x in p}
    for _ in up:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    df = spark.createDataFrame(pairs, "a long, b long")
    for most in (len(pairs), len(pairs) - 1):
        assert sorted(map(tuple, similar.closed(df, most).collect())) == sorted(up.items())
    assert similar.closed(df.limit(0)).collect() == []
    texts = near_texts(random.Random(43))
    roots = lambda: {r.doc_id: r.root for r in similar.classes(docs(spark, texts), hot=4).collect()}
    rounds, calls = simhash.components, []
    monkeypatch.setattr(similar, "components", lambda links: calls.append(1) or rounds(links))
    got = roots()
    assert not calls
    monkeypatch.setattr(similar, "closed", similar.components, raising=False)
    assert roots() == got and len(calls) == 3


def test_pipeline_near_dedup(spark):
    import corpus_pipeline

    texts = near_texts(random.Random(23))
    kept = corpus_pipeline.near_dedup(spark, docs(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_similar(texts)))


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return len(a) - len(b) <= 1 and (a[k + 1 :] == b[k:] if len(a) > len(b) else a[k + 1 :] == b[k + 1 :])


def brute_pipeline(rows, items):
    """doc_id -> ids, from rows (doc_id, text, lang): each stage by its plain version."""
    import sentencepiece

    def good(text, lang):
        n, chars, _, _, repeated = brute_quality(text)
        a, b, c, d, e, f = brute_measures(text)
        band = quality.BANDS[lang]
        return n >= 50 and 100 * repeated <= 50 * n and band.chars_per_token[0] <= a <= band.chars_per_token[1] and f >= band.chars_per_byte_level_token and band.tokens_per_word[0] <= b <= band.tokens_per_word[1] and c <= band.byte_share and d >= band.entropy and e <= band.top_share

    kept = [(k, t) for k, t, lang in rows if good(t, lang)]
    first = {}
    for k, t in kept:
        for at, x in enumerate(t.split("\n")):
            if x.strip(" \t\n\r\x0b\x0c"):
                first.setdefault(x, (k, at))
    by_size = {}
    for x in first:
        by_size.setdefault(len(x), []).append(x)
    near = {x for x in first if any(first[y] < first[x] and one_edit(x, y) for n in (-1, 0, 1) for y in by_size.get(len(x) + n, []) if y != x)}
    lined = [(k, "\n".join(x for at, x in enumerate(t.split("\n")) if not x.strip(" \t\n\r\x0b\x0c") or first[x] == (k, at) and x not in near)) for k, t in kept]
    roots = brute_similar([t for _, t in lined])
    lone = [lined[k] for k in sorted(set(roots))]
    bad = {d for d, _ in plain_leaks([t for _, t in lone], items)}
    model = sentencepiece.SentencePieceProcessor(model_file=f"{quality.TOKENIZERS}/{quality.MODEL}")
    return [len(kept), len([1 for _, t in lined if t]), len(lone), len(bad)], {k: model.encode(t) for n, (k, t) in enumerate(lone) if n not in bad}


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(61)
    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 4000").orderBy("doc_id").limit(90).collect()
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(15).collect()]
    rows = [(r.text, r.lang) for r in own]
    for text, lang in rng.sample(rows[:60], 25):  # copies with a few words changed, on lines of their own, and passages of the benchmark
        words = (text or "").replace("\n", " ").split(" ")
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((" ".join(words), lang))
    rows += [(f"{t[: len(t) // 2]} {rng.choice(items)} {t[len(t) // 2 :]}", lang) for t, lang in rng.sample([r for r in rows[:60] if r[0]], 12)]
    rows += [rows[3], rows[4], (None, "en"), ("", "en")]
    made = [(k, t, lang) for k, (t, lang) in enumerate(rows)]
    spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, t, lang in made], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sizes, want = brute_pipeline(made, items)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 30
    assert sizes[0] > sizes[2] > len(want) and sizes[3] > 3
    empty = f"{tmp_path}/none"
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stages_take_odd_tables(spark):
    """Each stage with nulls, empty and long texts, repeated rows, columns of clashing names, and no rows."""
    import corpus_pipeline

    names = ["d", "t", "h", "g", "fp", "row", "__id", "mask", "hash", "text_hash", "item_id", "root", "a.b"]
    odd = docs(spark, [*EDGE, "word " * 30_000, "long line " * 9_000]).drop("h", "fp").withColumns({n: F.lit(n) for n in names})
    odd = odd.union(odd).union(odd.withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, "/root/testdata/sf0.001")
        assert name == "sentencepiece" or out.columns == odd.columns
        assert out.count() <= odd.count() and stage(spark, odd.limit(0), "/root/testdata/sf0.001").count() == 0


def test_crowded_blocks_lose_no_link(spark):
    rng = random.Random(9)
    prints = {0}
    while len(prints) < 400:  # chains around a few centres
        p = rng.choice(sorted(prints))
        for b in rng.sample(range(64), rng.choice([1, 2, 3])):
            p ^= 1 << b
        prints.add(p)
    own = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in own], "fp long")
    roots = []
    for hot in (2, 1_000):
        pairs = [(r.a, r.b) for r in simhash.near_pairs(df, hot).collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in pairs)
        up = {p: p for p in own}

        def find(k, up=up):
            while up[k] != k:
                k = up[k]
            return k

        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            up[y] = x
        roots.append([find(p) for p in own])
    assert roots[0] == roots[1]
    up = {r.node: r.root for r in simhash.components(simhash.near_pairs(df, 2)).collect()}
    assert [up.get(p, p) for p in own] == roots[0]


# --- 9

def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(texts):
    first, gone = {}, []
    every = [(d, k, x) for d, t in enumerate(texts) if t is not None for k, x in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    for d, k, x in every:
        first.setdefault(x, (d, k))
    near = {x for x in first if any(abs(len(x) - len(y)) <= 1 and first[y] < first[x] and lev(x, y) <= 1 for y in first if y != x)}
    gone = {(d, k) for d, k, x in every if first[x] != (d, k) or x in near}
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in enumerate(texts)]


def test_line_dedup(spark):
    rng = random.Random(10)
    pool = [prose(rng, rng.randint(2, 7)) for _ in range(12)] + ["naïve café déjà vu " * 3, "En.", "Er."]

    def edited(x):
        k = rng.randrange(len(x))
        return rng.choice([x, x, x[:k] + x[k + 1 :], x[:k] + rng.choice("abé") + x[k:], x[:k] + "q" + x[k + 1 :], x[:k] + "zz" + x[k:]])

    short = ["a", "b", "ab", "é", "xyz", "xyzw", "12", "123456", "124456", "short line abc", "short line abd"]
    texts = EDGE + ["\n".join(rng.choice([edited(rng.choice(pool)), prose(rng, 6), " ", "", edited(rng.choice(short))]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    gone = [sorted(map(tuple, lines.removals(docs(spark, texts).select("doc_id", "text"), hot).collect())) for hot in (1, 3, 1000)]
    assert gone[0] == gone[1] == gone[2] and len(gone[0]) > 100
    got = {r.row.doc_id: r for r in lines.without_repeats(docs(spark, texts)).collect()}
    assert [got[k].text for k in range(len(texts))] == brute_lines(texts)
    out = lines.dedup_lines(docs(spark, texts))
    assert out.columns == docs(spark, texts).columns and out.count() == len(texts)
    twice = docs(spark, ["same line of words\nsame line of words"])
    assert [r.text for r in lines.dedup_lines(twice.union(twice)).collect()] == ["same line of words"] * 2
    assert lines.without_repeats(docs(spark, [])).count() == 0


# --- 10

def test_pieces(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{quality.TOKENIZERS}/{quality.MODEL}")
    rng = random.Random(11)
    letters = list("abcdefgh ABC  \n\t.,!012éñ日本語漢😀\u3000-<>")
    texts = EDGE + ["<s> </s> <0x0A>", "  two  spaces ", "a▁b", "ab" * 400] + ["".join(rng.choices(letters, k=rng.randint(1, 300))) for _ in range(150)]
    encoded = pieces.encode_texts(docs(spark, texts))
    rows = encoded.collect()
    assert [r.ids for r in rows] == [model.encode(t or "") for t in texts] and all(r.exact and r.n_tokens == len(r.ids) for r in rows)
    back = pieces.decode_ids(encoded).collect()
    assert [r.text for r in back] == [(t or "").replace("▁", " ") for t in texts]
    assert pieces.encode_texts(docs(spark, [])).count() == 0


def test_long_segments_by_windows(monkeypatch):
    import sentencepiece

    path = f"{quality.TOKENIZERS}/{quality.MODEL}"
    model, vocab, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.vocabulary(path), random.Random(14)
    texts = ["a" * 9_001, "ab" * 5_000 + "c", "".join(rng.choices("etaoinshrdlu", k=20_000)), "".join(rng.choices("日本語漢字é😀ab", k=9_000)), "the" * 4_000, "-" * 10_000 + "=" * 5_000, "".join(rng.choices("ab", k=12_000)), "".join(rng.choices("0123456789", k=12_000))]
    for text in texts:
        for window in (300, 4096):
            assert pieces.encode_long(pieces.MARK + text, vocab, window).tolist() == model.encode(text)
    monkeypatch.setattr(pieces, "BLOCK", 5_000)
    monkeypatch.setattr(pieces, "REMEMBERED", 100)
    mixed = [" ".join(texts), prose(rng, 5_000), None, texts[2], texts[2], " ".join(texts)]
    ids, n = pieces.Encoder(path).encode(mixed)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [model.encode(t or "") for t in mixed]


def test_long_text_needs_little_memory():
    import resource
    import subprocess
    import sys

    code = "import resource, random, sys; sys.path.insert(0, sys.argv[1]); from lexloom.llm import pieces; e = pieces.Encoder(sys.argv[2]); e.encode(['x']); a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; e.encode([''.join(random.Random(1).choices('etaoinshrdlu', k=1_000_000))]); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a)"
    used = int(subprocess.run([sys.executable, "-c", code, str(pieces.__file__).rsplit("/lexloom/", 1)[0], f"{quality.TOKENIZERS}/{quality.MODEL}"], capture_output=True, text=True, check=True).stdout)
    assert used < 400_000 and resource


@pytest.mark.parametrize("wide", [False, True])
def test_suffix_ranges(wide):
    vocab = pieces.vocabulary(f"{quality.TOKENIZERS}/{quality.MODEL}")
    text = "▁the▁theme\0日本▁hello" + "".join(chr(0x4E00 + k) for k in range(400)) * wide
    got = {(int(p), vocab.texts[k]) for p, k in zip(*pieces.matches(text, vocab), strict=True)}
    assert got == {(m.start(), t) for t in vocab.texts for m in re.finditer(f"(?={re.escape(t)})", text)}
