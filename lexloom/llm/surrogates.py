"""PII surrogates: detected entities are replaced by keyed values of their own type, gender, script and format.

A surrogate is a keyed permutation of the entity's symbols within its format: digits stay digits, vowels
vowels, consonants consonants of the same script, case and punctuation stay, check digits are made anew,
titles and so gender stay, and known given names are permuted among those of the same gender
and script. The permutation is a Feistel network, a step of one, and the network back, so that none of a format's
values stays as it was. As each format is permuted in itself, two entities never share a surrogate, and one entity,
however it is written (national and international phone numbers too), has the same one in every document.
Surnames are invented words for that reason.

Persons are found by titles, by known given names, and by what is said about them ("Priya Raman replied", "signed by
Priya Raman"); a part of a name found in a document is replaced wherever it stands alone in it.
pseudonymise() counts ``clashes``: surrogates in a text that equal a real value found elsewhere in the corpus.
collisions() checks distinctness and coreference over a whole corpus.

Defined cases: a null text stays null and has no entities; spans don't overlap, the earlier and then the
longer one holds; a format with one value stays as it is; repeated rows are treated alike; an empty table gives an empty
result; columns beside the id and text play no part; a text of any length is searched whole.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, columns, sliced, stored, table

#: The key of the registered query, whose result is checked in the open. Every other use passes a secret of its own.
QUERY_KEY = b"of the registered query only"

GIVEN = {
    ("f", "latin"): "alice amelia anna anne barbara beatrice camille carla carmen caroline charlotte claire clara elena elisabeth elizabeth emily emma eva fiona frances grace hannah helen ines isabel jane jennifer julia karen katharina laura linda lucia lucy margaret maria marie martha mary monika nancy olivia patricia petra rachel rebecca rosa ruth sabine sarah sofia sophie susan teresa ursula victoria virginia".split(),
    ("m", "latin"): "adam albert alexander andrew anthony antonio arthur bernard brian carlos charles christian daniel david dieter edward eric francisco frank george hans harry henry hugo jack jacques james jean jose joseph john juan karl kenneth klaus louis lucas luis manuel mark martin matthew michael miguel nicolas oliver oscar pablo patrick paul pedro peter philip pierre ralph richard robert samuel simon stephen stefan thomas walter werner william".split(),
    ("f", "cyrillic"): "анна мария елена ольга наталья ирина татьяна светлана екатерина юлия дарья вера надежда любовь галина людмила".split(),
    ("m", "cyrillic"): "иван пётр николай алексей сергей андрей дмитрий михаил владимир александр борис виктор павел юрий олег игорь".split(),
    ("f", "greek"): "μαρία ελένη αικατερίνη βασιλική σοφία αγγελική γεωργία δήμητρα ιωάννα κωνσταντίνα".split(),
    ("m", "greek"): "γεώργιος ιωάννης κωνσταντίνος δημήτριος νικόλαος παναγιώτης βασίλειος χρήστος αθανάσιος μιχαήλ".split(),
}
BY_NAME = {name: kind for kind, names in GIVEN.items() for name in names}
#: Letters that may stand for one another.
ALPHABETS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûüœ", "çðñýþßšžćčđłńśźż", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψ"]
PLACE = {c: (a, k) for a, letters in enumerate(ALPHABETS) for k, c in enumerate(letters)}
HEX = "0123456789abcdef"


@lru_cache(maxsize=4096)
def _salted(key: bytes, tweak: str) -> hmac.HMAC:
    return hmac.new(key, tweak.encode(), hashlib.sha256)


def _rounds(out: list[int], radix: list[int], salted: hmac.HMAC, steps: Iterable[int], sign: int) -> None:
    halves = (range(0, len(out), 2), range(1, len(out), 2))
    for r in steps:
        mine, others = halves[r % 2], halves[1 - r % 2]
        h = salted.copy()
        h.update(bytes((r,)) + b",".join(b"%d" % out[k] for k in others))
        stream = h.digest()
        while len(stream) < 4 * len(mine):
            stream += hashlib.sha256(stream).digest()
        for n, k in enumerate(mine):
            out[k] = (out[k] + sign * int.from_bytes(stream[4 * n : 4 * n + 4], "big")) % radix[k]


def permute(symbols: list[int], radix: list[int], key: bytes, tweak: str, rounds: int = 2) -> list[int]:
    """A keyed bijection of the words of that format, all on one cycle: an alternating Feistel network over mixed radices, the next word, and the network back."""
    out, salted = list(symbols), _salted(key, f"{tweak}|{radix}")
    _rounds(out, radix, salted, range(2 * rounds), 1)
    for k in range(len(out)):
        out[k] = (out[k] + 1) % radix[k]
        if out[k]:
            break
    _rounds(out, radix, salted, reversed(range(2 * rounds)), -1)
    return out


def letters(text: str, key: bytes, tweak: str) -> str:
    """Each symbol within its alphabet, case kept; what is in none stays."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    at = [k for k, c in enumerate(low) if c in PLACE]
    kinds = [PLACE[low[k]][0] for k in at]
    shape = "".join(chr(65 + PLACE[c][0]) if c in PLACE else c for c in low)
    new = permute([PLACE[low[k]][1] for k in at], [len(ALPHABETS[a]) for a in kinds], key, f"{tweak}|{shape}")
    out = list(text)
    for k, a, s in zip(at, kinds, new, strict=True):
        c = ALPHABETS[a][s]
        out[k] = c.upper() if text[k] != low[k] and len(c.upper()) == 1 else c
    return "".join(out)


def digits(text: str, key: bytes, tweak: str, keep: int = 0, luhn: bool = False) -> str:
    """The digits permuted but for the first ``keep``; whatever stands between them stays. luhn: the last one is made to check."""
    own = [int(c) for c in text if c in "0123456789"]
    body = own[keep : len(own) - luhn]
    new = own[:keep] + permute(body, [10] * len(body), key, f"{tweak}|{own[:keep]}|{len(own)}|{luhn}")
    if luhn:
        new.append(-luhn_sum(new + [0]) % 10)
    at = iter(new)
    return "".join(str(next(at)) if c in "0123456789" else c for c in text)


def luhn_sum(own: list[int]) -> int:
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(own)))


def _email(text: str, key: bytes) -> str:
    name, dot, end = text.rpartition(".")
    return letters(name, key, f"email|{end.lower()}") + dot + end


def phone_parts(text: str) -> tuple[str, str]:
    """(country code or trunk zero, national number)"""
    own = re.sub(r"\D", "", text)
    cut = (1 if own[:1] in "17" else 2) if text.lstrip().startswith("+") else int(own.startswith("0") and len(own) > 7)
    if text.lstrip().startswith("+") and own[cut : cut + 1] == "0" and "(0)" in text:
        cut += 1
    return own[:cut], own[cut:]


def _phone(text: str, key: bytes) -> str:
    before, own = phone_parts(text)
    lead = own[:1] != "0"  # stays so, or the number would look like one with a trunk zero
    made = permute([int(own[0]) - 1, *map(int, own[1:])], [9, *[10] * (len(own) - 1)], key, "phone") if lead else [0, *permute([int(c) for c in own[1:]], [10] * (len(own) - 1), key, "phone")]
    new = iter([*map(int, before), made[0] + lead, *made[1:]])
    return "".join(str(next(new)) if c in "0123456789" else c for c in text)


def _date(text: str, key: bytes) -> str:
    """Another day, month and year of the century; the 29th to 31st keep day and month, and a 29 February a leap year."""
    parts = [int(x) for x in re.findall(r"\d+", text)]
    year_first = len(re.findall(r"\d+", text)[0]) == 4
    named = MONTH.search(text)
    day, year = (parts[-1], parts[0]) if year_first else (parts[0], parts[-1])
    month = MONTHS.index(named[0].lower()[:3]) + 1 if named else parts[1]
    if not (1 <= day <= 31 and 1 <= month <= 12):
        return digits(text, key, "date")
    century, short = divmod(year, 100)
    if day <= 28:
        short, month, day = (x + y for x, y in zip(permute([short, month - 1, day - 1], [100, 12, 28], key, f"date|{century}"), (0, 1, 1), strict=True))
    elif (day, month) == (29, 2):
        short = permute([short // 4], [25], key, f"leap|{century}")[0] * 4
    else:
        short = permute([short], [100], key, f"year|{century}|{month}|{day}")[0]
    values = [century * 100 + short, month, day] if year_first else [day, month, century * 100 + short]
    new = iter(values)
    if named:
        word = LONG_MONTHS[month - 1] if len(named[0]) > 3 else MONTHS[month - 1].title()
        new = iter((values[0], values[2]))
        text = text[: named.start()] + "\0" + text[named.end() :]
    out = re.sub(r"\d+", lambda m: str(next(new)).zfill(len(m[0])), text)
    return out.replace("\0", word) if named else out


def _ip6(text: str, key: bytes) -> str:
    """The groups but the first; zeros that the short form leaves out stay out."""
    head, colon, rest = text.partition(":")
    at = [k for k, c in enumerate(rest) if c != ":"]
    new = permute([HEX.index(rest[k].lower()) for k in at], [16] * len(at), key, f"ip6|{head.lower()}|{''.join(':' if c == ':' else 'x' for c in rest)}")
    out = list(rest)
    for k, n in zip(at, new, strict=True):
        out[k] = HEX[n].upper() if rest[k].isupper() else HEX[n]
    return head + colon + "".join(out)


def _address(text: str, key: bytes) -> str:
    """House number and the street's own words; its kind stays."""

    def word(m: re.Match) -> str:
        return m[0] if STREET_WORD.fullmatch(m[0]) or m[0].lower() in PARTICLES else letters(m[0], key, "street")

    def named(m: re.Match) -> str:
        return letters(m[1], key, "street") + m[2]

    out = re.sub(r"\d+", lambda m: digits(m[0], key, "house"), text)
    return re.sub(r"[^\W\d_]+", lambda m: GERMAN_STREET.sub(named, m[0]) if GERMAN_STREET.fullmatch(m[0]) else word(m), out)


def _card(text: str, key: bytes) -> str:
    own = [int(c) for c in text if c in "0123456789"]
    return digits(text, key, "card", luhn=luhn_sum(own) % 10 == 0)


def _private(octets: list[int]) -> int:
    """How many leading octets name a reserved network."""
    a, b = octets[:2]
    return 1 if a in (0, 10, 127) or a >= 224 else 2 if (a, b) in ((192, 168), (169, 254)) or a == 172 and 16 <= b < 32 else 0


def _ip(text: str, key: bytes) -> str:
    octets = [int(x) for x in text.split(".")]
    fixed = _private(octets)
    rest = octets[fixed:]
    while True:  # from a public address on to the next public one of its cycle
        rest = permute(rest, [256] * len(rest), key, f"ip|{octets[:fixed]}")
        if fixed or not _private(rest):
            return ".".join(map(str, octets[:fixed] + rest))


def _iban(text: str, key: bytes) -> str:
    plain = re.sub(r"\s", "", text).upper()
    body = letters(plain[4:], key, f"iban|{plain[:2]}").upper()
    check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
    new = iter(plain[:2] + f"{check:02d}" + body)
    return "".join(c if c.isspace() else next(new) for c in text)


def _secret(text: str, key: bytes) -> str:
    low = text.lower()
    if all(c in HEX for c in low):
        new = permute([HEX.index(c) for c in low], [16] * len(low), key, "hex")
        return "".join(HEX[n].upper() if c.isupper() else HEX[n] for n, c in zip(new, text, strict=True))
    return letters(text, key, "secret")


@lru_cache(maxsize=64)
def _shuffled(kind: tuple[str, str], key: bytes) -> dict[str, str]:
    """The given names of a gender and script on a keyed cycle: each moves on to the next."""
    order = sorted(GIVEN[kind], key=lambda n: hmac.new(key, f"given|{n}".encode(), hashlib.sha256).digest())
    return dict(zip(order, order[1:] + order[:1], strict=True))


def _name(word: str, key: bytes) -> str:
    low = word.lower()
    if kind := BY_NAME.get(low):
        new = _shuffled(kind, key)[low]
        return new.upper() if word.isupper() and len(word) > 1 else new.capitalize()
    out = letters(word, key, "name")
    while out.lower() in BY_NAME:  # on to the next of its cycle that isn't a known given name
        out = letters(out, key, "name")
    return out


def _person(text: str, key: bytes) -> str:
    return re.sub(r"[^\W\d_]+", lambda m: m[0] if m[0].lower() in PARTICLES else _name(m[0], key), text)


LONG_MONTHS = "January February March April May June July August September October November December".split()
MONTHS = [m[:3].lower() for m in LONG_MONTHS]
MONTH = re.compile(rf"\b(?:{'|'.join(f'{m[:3]}(?:{m[3:]})?' for m in LONG_MONTHS)})\b", re.I)
STREET_WORD = re.compile(r"(?i:street|st|road|rd|avenue|ave|lane|drive|square|terrace|close|way|boulevard|blvd|rue|calle|avenida|plaza|place|chemin|allée)")
GERMAN_STREET = re.compile(r"([A-ZÄÖÜ][^\W\d_]{1,30}?)(straße|strasse|weg|gasse|platz|allee)")
PARTICLES = {"de", "van", "von", "der", "den", "la", "le", "du", "da", "di", "del", "bin", "al", "y", "and"}
_W = r"[^\W\d_]"
_CAP = rf"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω](?:{_W}|['’-](?={_W})){{0,30}}"
#: A capitalised word with another one after it, perhaps a given name.
_BEFORE_NAME = re.compile(r"\b[A-ZÀ-ÞА-ЯΑ-ΩΆ-Ώ][a-zà-öø-ÿа-яёα-ωά-ώ]{2,14}(?=[ \u00a0][A-ZÀ-ÞА-ЯΑ-ΩΆ-Ώ])")
#: What is said of persons or before their names, and two to three capitalised words that aren't all a place's, a body's or a day's.
_SAID = "said|says|wrote|writes|replied|agreed|asked|answered|told|signed|called|lives|lived|explained|added|was born|can be reached"
_BY = "[Ss]igned by|[Ww]ritten by|[Mm]y name is|[Nn]ame:|[Aa]ttn\\.?|[Cc]ontact|[Cc]ontacted by|[Rr]egards,|[Ss]incerely,"
_NO_NAME = "Mr|Mrs|Ms|Mx|Miss|Dr|Prof|Sir|Dame|Herr|Frau|The|This|That|These|Those|Our|Your|Their|His|Her|Its|In|On|At|For|From|With|When|While|After|Before|Street|Road|Avenue|University|Company|Ltd|Inc|Bank|Court|Department|Ministry|Committee|Council|North|South|East|West|New|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|May|June|July|August|September|October|November|December"
_TWO = rf"(?!(?:\w+[ \u00a0])?(?:{_NO_NAME})\b)[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:[ \u00a0](?!(?:{_NO_NAME})\b)[A-ZÀ-ÖØ-Þ](?:[a-zß-öø-ÿ]+|['’-](?=\w)){{1,4}}){{1,2}}"
_NUMBERS = re.compile(r"\d[^\w\s]?\d|\d:|:[0-9A-Fa-f]")
#: kind, cheap test (one of these in lower case, or in a text with numbers a pattern), pattern, surrogate. The group ``v``, if any, is what is replaced.
RULES = [
    ("email", ("@",), re.compile(r"(?<![\w.%+-])[\w%+-](?:[\w.%+-]{0,63}[\w%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![\w@-])"), _email),
    ("secret", ("token", "secret", "passw", "api", "bearer", "akia", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"(?i:\b(?:[a-z]{0,20}_?(?:token|secret|passwd|password)|api[_ -]?key|access[_ -]?key|bearer)\b[\"']?\s{0,3}(?:[:=]\s{0,3}|\s)[\"']?)(?P<v>(?=[A-Za-z_+/=-]{0,60}\d)[A-Za-z0-9_+/=-]{12,128})(?![\w+/=-])|\b(?P<v2>AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,64}|gh[pousr]_[A-Za-z0-9]{30,64})\b"), _secret),
    ("ip", re.compile(r"\d\.\d"), re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"), _ip),
    ("ip", re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f:]"), re.compile(r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"), _ip6),
    ("address", (" street", " st", " road", " rd", " ave", " lane", " drive", " square", " terrace", " close", " way", " boulevard", " blvd", "rue ", "place ", "chemin ", "allée ", "straße ", "strasse ", "weg ", "gasse ", "platz ", "allee ", "calle ", "plaza "), re.compile(r"(?<![\w.])\d{1,4}[a-z]?,? (?:[A-Z][^\W\d_]+ ){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Drive|Square|Terrace|Close|Way|Boulevard|Blvd)\b|(?<![\w.])\d{1,4},? (?:rue|avenue|boulevard|place|chemin|allée)(?: (?:de|du|des|la|le))*(?: [A-ZÀ-Ý][^\W\d_]+){1,3}|\b[A-ZÄÖÜ][^\W\d_]{1,30}(?:straße|strasse|weg|gasse|platz|allee) \d{1,4}\b|\b(?:Calle|Avenida|Plaza)(?: (?:de|del|la))*(?: [A-ZÁÉÍÓÚÑ][^\W\d_]+){1,3},? \d{1,4}\b"), _address),
    ("date", ("born", "dob", "birth", "geboren", "geb", "né", "nacid"), re.compile(r"(?i:\b(?:born(?: on)?|dob|date of birth|geboren(?: am)?|geb\.?|née?(?: le)?|nacid[oa](?: el)?)[: ]{1,3})(?P<v>\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2} (?i:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]{0,6}) \d{4})\b"), _date),
    ("iban", re.compile(r"[A-Z]{2}\d\d"), re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), _iban),
    ("ssn", re.compile(r"\d-\d\d-\d"), re.compile(r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"), lambda t, key: digits(t, key, "ssn")),
    ("card", re.compile(r"\d{4}[ -]?\d{4}"), re.compile(r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w]|[.-]\d)"), _card),
    ("phone", re.compile(r"\d{3}\D{0,2}\d{2}"), re.compile(r"(?<![\w+.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{2,4}[ -]\d{3,4}[ -]\d{3,4})(?![\w]|[.-]\d)"), _phone),
    ("person", ("mr", "ms", "mx", "miss", "dr", "prof", "sir ", "dame ", "madame", "mme", "monsieur", "herr", "frau", "señor", "sr", "doña", "don"), re.compile(rf"\b(?:Mr|Mrs|Ms|Mx|Miss|Dr|Prof|Sir|Dame|Madame|Mme|Monsieur|Herr|Frau|Señora?|Sra?|Doña|Don)\b\.?[ \u00a0](?P<v>{_CAP}(?:[ \u00a0](?:(?:de|van|von|der|den|la|le|du|da|di|del|y|al|bin)[ \u00a0]){{0,2}}{_CAP}){{0,3}})"), _person),
    ("person", tuple(f" {w}" for w in _SAID.split("|")), re.compile(rf"(?:(?<=[a-zß-ÿ,;:] )|(?<=^)|(?<=\n)|(?<=[.!?] ))(?P<v>{_TWO})(?= (?:{_SAID})\b)"), _person),
    ("person", ("signed by", "written by", "my name is", "name:", "attn", "contact", "regards,", "sincerely,"), re.compile(rf"\b(?:{_BY})[: ]{{1,2}}(?P<v>{_TWO})"), _person),
    ("person", (), re.compile(rf"{_CAP}(?:[ \u00a0][A-ZÀ-ÞА-ЯΑ-Ω]\.)?[ \u00a0]{_CAP}"), _person),
]


def entities(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, rule), apart from one another, by place."""
    found, low, numbers = [], text.lower(), _NUMBERS.search(text)
    for n, (kind, hint, pattern, _) in enumerate(RULES):
        if (not hint or any(h in low for h in hint)) if isinstance(hint, tuple) else numbers and hint.search(text):
            hits = pattern.finditer(text) if n < len(RULES) - 1 else filter(None, (pattern.match(text, m.start()) for m in _BEFORE_NAME.finditer(text) if m[0].lower() in BY_NAME))
            for m in hits:
                v = next((g for g in ("v", "v2") if m.groupdict().get(g) is not None), 0)
                if kind != "iban" or _valid_iban(m[0]):
                    found.append((m.start(v), -m.end(v), n, kind))
    names = {w for a, b, _, kind in found if kind == "person" for w in _NAME_PART.findall(text[a:-b]) if w.lower() not in PARTICLES}
    if names:
        person = next(n for n, r in enumerate(RULES) if r[0] == "person")
        alone = re.compile(rf"(?<![\w@.-])(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})(?![\w@]|[.-]\w)")
        found += [(m.start(), -m.end(), person, "person") for m in alone.finditer(text)]
    out, end = [], 0
    for a, b, n, kind in sorted(found):
        if a >= end:
            out.append((a, end := -b, kind, n))
    return out


#: A part of a name that is taken up alone: long enough not to be an initial or a common short word.
_NAME_PART = re.compile(r"[^\W\d_]{3,}")


def _valid_iban(text: str) -> bool:
    plain = re.sub(r"\s", "", text)
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[str, str, str]]]:
    """(text with surrogates, (kind, original, surrogate) by place)"""
    out, at, said = [], 0, []
    for a, b, kind, n in entities(text):
        new = RULES[n][3](text[a:b], key)
        out += [text[at:a], new]
        said.append((kind, text[a:b], new))
        at = b
    return "".join([*out, text[at:]]) if said else text, said


def canonical(kind: str, text: str) -> str:
    """What two spellings of one entity share."""
    if kind == "phone":
        return phone_parts(text)[1]
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", text)
    return re.sub(r"\s", "", text).upper() if kind == "iban" else re.sub(r"\s+", " ", text).lower()


def digest(kind: str, text: str, key: bytes) -> int:
    return int.from_bytes(hmac.new(key, f"{kind}|{canonical(kind, text)}".encode(), hashlib.sha256).digest()[:8], "big", signed=True)


MADE = "doc_id long, text string, n_entities long, kinds string, originals array<long>, surrogates array<long>"


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities, kinds (sorted, comma-joined), clashes: how many of the text's surrogates equal a real value of the corpus. No original is in the result.

    Texts are worked on once and written; only digests, distinct for each task, are shuffled to look for clashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            out = [(None, []) if t is None else replaced(t, key) for t in batch.column("text").to_pylist()]
            said = [s for _, s in out]
            numbers = lambda n: pa.array([[digest(x[0], x[n], key) for x in s] for s in said], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([t for t, _ in out], pa.string()), pa.array([len(s) for s in said], pa.int64()), pa.array([",".join(sorted({x[0] for x in s})) for s in said], pa.string()), numbers(1), numbers(2)], names=["doc_id", "text", "n_entities", "kinds", "originals", "surrogates"])

    made = stored(columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, MADE), "surrogates")
    real = made.select(F.explode("originals").alias("s")).distinct()
    clashing = checkpointed(made.select(F.explode("surrogates").alias("s")).distinct().join(real, "s"))
    kept = ["doc_id", "text", "n_entities", "kinds"]
    if clashing.isEmpty():
        return made.select(*kept, F.lit(0).cast("long").alias("clashes"))
    rows = made.withColumn("row", F.monotonically_increasing_id())
    counts = rows.select("row", F.explode("surrogates").alias("s")).join(clashing, "s").groupBy("row").agg(F.count("*").alias("clashes"))
    return rows.join(counts, "row", "left").select(*kept, F.coalesce("clashes", F.lit(0)).alias("clashes"))


def collisions(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """kind, surrogate, originals: surrogates that stand for several entities, or entities with several surrogates (surrogate null). Empty if all is well.

    Entities are compared by keyed digests; the sums over them are partly made before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            rows = {(k, digest(k, a, key), digest(k, b, key)) for t in batch.column("text").to_pylist() if t for k, a, b in replaced(t, key)[1]}
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[n] for r in rows], pa.int64()) for n in (1, 2))], names=["kind", "original", "surrogate"])

    pairs = columns(docs, text=text_col).mapInArrow(run, "kind string, original long, surrogate long").distinct()
    shared = pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("originals")).filter("originals > 1")
    torn = pairs.groupBy("kind", "original").agg(F.count("*").alias("originals")).filter("originals > 1").select("kind", F.lit(None).cast("long").alias("surrogate"), "originals")
    return shared.union(torn)


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), QUERY_KEY)
