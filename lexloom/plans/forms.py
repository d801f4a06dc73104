"""Queries over texts of many shapes, each from a table of cases: SQL expressions, alike in Spark and in DuckDB, of what a text says and of what the engine should find.

Every row of ``customer`` makes a text: case number k modulo the number of cases, between fillers of different
length, with names, years and numbers of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import chunks, citations, fixed, metrics, pii, prompts, training
from lexloom.functions.jurisdictions import jurisdiction
from lexloom.operators import benchmark, dataset

QUERIES: dict = {}
SQL: dict[str, str] = {}

_NAMES = "'Moss,Ward,Hale,Orr,Lund,Pike,Voss,Holm,Bligh,Crane,Dunn'"
_COLUMNS = (
    "c_custkey AS k, 1990 + c_custkey % 30 AS y, c_custkey % 400 + 1 AS n, c_nationkey + 1 AS p, split_part({0}, ',', CAST(c_custkey % 11 + 1 AS INT)) AS a, split_part({0}, ',', CAST((c_custkey + c_nationkey) % 11 + 1 AS INT)) AS b, "
    "split_part('The judge agreed. |On appeal it was said: |We note this: |As the tribunal put it, |', '|', CAST(c_custkey % 5 + 1 AS INT)) AS pre, split_part('.|, and so it was ordered.|; the rest stands.|.', '|', CAST(c_nationkey % 4 + 1 AS INT)) AS post"
).format(_NAMES)
BASE = f"(SELECT {_COLUMNS} FROM customer)"


def rows_of(spark, d: str, **columns: str) -> DataFrame:
    base = dataset.dealt(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey")).selectExpr(*[c.strip() for c in _split(_COLUMNS)])
    return base.select("*", *[F.expr(e).alias(n) for n, e in columns.items()])


def _split(columns: str) -> list[str]:
    """At the commas outside brackets and quotes."""
    out, depth, quoted, at = [], 0, False, 0
    for k, c in enumerate(columns):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(columns[at:k])
            at = k + 1
    return [*out, columns[at:]]


def chosen(cases: list[str]) -> str:
    """The case's expression, by k."""
    return f"CASE k % {len(cases)} " + " ".join(f"WHEN {j} THEN {e}" for j, e in enumerate(cases)) + " END"


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


# ---- citations: a case is a list of plain parts and of (what is cited, its normal form) ----


def cited(*parts) -> tuple[str, str, str, str]:
    """(text, normal forms, what stands in the text, where it starts)"""
    text, normal, raw, at = "pre", [], [], []
    for part in parts:
        if isinstance(part, tuple):
            raw.append(part[0])
            normal.append(part[-1])
            at.append(f"CAST(length({text}) AS STRING)")
            text = f"{text} || {part[0]}"
        else:
            text = f"{text} || {part}"
    joined = lambda xs: " || '; ' || ".join(xs) if xs else "''"
    return f"{text} || post", joined(normal), joined(raw), joined(at)


def citation_query(name: str, cases: list[tuple], unique: bool = True) -> None:
    text, normal, raw, at = (chosen([c[j] for c in cases]) for j in range(4))
    QUERIES[name] = lambda spark, d: (
        rows_of(spark, d, text=text).withColumn("c", citations.citations_of(F.col("text"), unique))
        .select("k", *[F.array_join(F.col(f"c.{f}").cast("array<string>"), "; ").alias(o) for f, o in (("normalised", "normal"), ("raw", "raw"), ("start", "starts"))])
    )
    SQL[name] = f"SELECT k, {normal} AS normal, {raw} AS raw, {at} AS starts FROM {BASE}".replace("AS STRING", "AS VARCHAR")


_same = lambda e: (e, e)

citation_query("citation_neutral", [
    cited("'In ' || a || ' v ' || b || ' '", _same("'[' || y || '] UKSC ' || n")), cited("'see '", ("'[' || y || '] ewca civ ' || n", "'[' || y || '] EWCA Civ ' || n")),
    cited("'Compare '", ("'[' || y || '] EWHC ' || n || ' (admin)'", "'[' || y || '] EWHC ' || n || ' (Admin)'"), "' with '", _same("'[' || y || '] UKHL ' || p")),
    cited("'nothing but [' || y || '] there'"), cited("'Re ' || a || ' '", _same("'[' || y || '] EWFC ' || n"), "' at [' || p || ']'"),
])
citation_query("citation_square_reports", [
    cited("'see '", ("'[' || y || '] 2 A.C. ' || n", "'[' || y || '] 2 AC ' || n")), cited("'see '", _same("'[' || y || '] 1 WLR ' || n"), "' and '", _same("'[' || y || '] 3 All ER ' || p")),
    cited("a || ' v ' || b || ' '", _same("'[' || y || '] ECR ' || n")), cited("'see '", _same("'[' || y || '] All ER (D) ' || n")), cited("'see '", _same("'[' || y || '] QB ' || n")),
])
citation_query("citation_round_reports", [
    cited("a || ' v ' || b || ' '", _same("'(18' || (60 + p) || ') 12 App Cas ' || n")), cited("'see '", _same("'(' || y || ') 2 EHRR ' || n")),
    cited("'see '", _same("'(18' || (60 + p) || ') LR 3 HL ' || n")), cited("'see '", _same("'(18' || (66 + p) || ') LR ' || p || ' QB ' || n"), "', then '", _same("'(' || y || ') 40 EHRR ' || p")),
])
citation_query("citation_provisions_first", [
    cited("'under '", ("'section ' || n || ' of the ' || a || ' Act ' || y", "a || ' Act ' || y || ', s ' || n")), cited("'under '", ("'Schedule ' || p || ' to the ' || a || ' Act ' || y", "a || ' Act ' || y || ', sch ' || p")),
    cited("'under '", ("'reg ' || p || '(2) of the ' || a || ' Regulations ' || y", "a || ' Regulations ' || y || ', reg ' || p || '(2)'")), cited("'section ' || n || ' of the agreement'"),
])
citation_query("citation_provisions_after", [
    cited("'by the '", _same("a || ' Act ' || y || ', s ' || n")), cited("'by the '", _same("a || ' Act ' || y")), cited("'by '", _same("'CPR r ' || p || '.4'")), cited("'an order of ' || y"),
])
citation_query("citation_united_states", [
    cited("a || ' v. ' || b || ', '", _same("n || ' U.S. ' || p"), "' (' || y || ')'"), cited("'see '", _same("n || ' F. Supp. 2d ' || p")), cited("'see '", _same("'42 U.S.C. § ' || n")),
    cited("'see '", ("'17 CFR ' || n || '.10'", "'17 C.F.R. § ' || n || '.10'")), cited("'see '", _same("n || ' F.3d ' || p"), "' and '", _same("p || ' S. Ct. ' || n")), cited("n || ' F ' || p || ' apples'"),
])
citation_query("citation_european_union", [
    cited("'see '", _same("'Case C-' || n || '/' || right(CAST(y AS STRING), 2)")), cited("'see '", ("'T-' || n || '/99 P'", "'Case T-' || n || '/99 P'")), cited("'see '", _same("'ECLI:EU:C:' || y || ':' || n")),
    cited("'by '", ("'Article ' || p || ' TFEU'", "'Art ' || p || ' TFEU'")), cited("'by '", ("'Article ' || p || '(1) of the UK GDPR'", "'Art ' || p || '(1) UK GDPR'")), cited("'by '", ("'art ' || p || ' ECHR'", "'Art ' || p || ' ECHR'")),
    cited("'by '", _same("'Directive ' || y || '/' || n || '/EU'")), cited("'by '", _same("'Regulation (EC) No ' || n || '/' || y")),
])
citation_query("citation_repeats_go", [
    cited("'see '", _same("'[' || y || '] UKSC ' || n"), "' and [' || y || '] uksc ' || n || ' again'"), cited("'see '", _same("'[' || y || '] UKSC ' || n"), "' and '", _same("'[' || y || '] UKSC ' || (n + 1)")),
])
citation_query("citation_repeats_stay", [
    cited("'see '", _same("'[' || y || '] UKSC ' || n"), "' and '", ("'[' || y || '] uksc ' || n", "'[' || y || '] UKSC ' || n")), cited("'see '", _same("'42 U.S.C. § ' || n"), "' and '", _same("'42 U.S.C. § ' || n")),
], unique=False)

_PARTIES = [
    ("'In ' || a || ' Ltd v ' || b || ' plc [' || y || '] UKSC ' || n", "a || ' Ltd v ' || b || ' plc'"), ("'the Court of Session in ' || a || ' v ' || b || ' [1931] AC ' || n", "a || ' v ' || b"), ("'Re ' || a || ' [' || y || '] EWHC ' || n || ' (Ch)'", "'Re ' || a"),
    ("'In re ' || a || ' and ' || b || ' [' || y || '] UKSC ' || n", "'In re ' || a || ' and ' || b"), ("'R (' || a || ') v Secretary of State for the Home Department [' || y || '] UKSC ' || n", "'R (' || a || ') v Secretary of State for the Home Department'"),
    ("a || ' v. Board of Trade, ' || n || ' U.S. ' || p || ' (1954)'", "a || ' v Board of Trade'"), ("'See [' || y || '] 1 AC ' || n", "'none'"), ("'Following ' || a || ' v ' || b || ' Ltd [1997] UKHL ' || n", "a || ' v ' || b || ' Ltd'"),
]


@query(f"SELECT k, {chosen([p for _, p in _PARTIES])} AS parties FROM {BASE}")
def case_parties(spark, d):
    rows = rows_of(spark, d, text=chosen([t for t, _ in _PARTIES])).select("k", F.explode(citations.citations_of(F.col("text"))).alias("c"))
    return rows.select("k", F.coalesce("c.parties", F.lit("none")).alias("parties"))


@query(f"SELECT k, {chosen(['CAST(p AS VARCHAR)', "p || '-' || (p + 3)", 'CAST(p AS VARCHAR)', "'none'"])} AS paragraph FROM {BASE}")
def pinpoints(spark, d):
    text = chosen(["'[' || y || '] UKSC ' || n || ' at [' || p || ']'", "'[' || y || '] UKSC ' || n || ' at [' || p || ']-[' || (p + 3) || ']'", "'[' || y || '] EWFC ' || n || ', para ' || p", "'[' || y || '] UKSC ' || n || ' was cited'"])
    return rows_of(spark, d, text=text).select("k", F.coalesce(citations.citations_of(F.col("text"))[0]["paragraph"], F.lit("none")).alias("paragraph"))


@query(f"SELECT k, {chosen(["pre || '[' || y || '] UKSC ' || n || ' and 17 CFR ' || n || '.10' || post", "pre || 'Case T-' || n || '/99 P' || post", "pre || 'no case' || post"])} AS text FROM {BASE}")
def texts_with_normal_citations(spark, d):
    text = chosen(["pre || '[' || y || ']  uksc  ' || n || ' and 17 CFR ' || n || '.10' || post", "pre || 'T-' || n || '/99 P' || post", "pre || 'no case' || post"])
    return rows_of(spark, d, text=text).select("k", citations.with_normal_citations(F.col("text")).alias("text"))


@query(f"SELECT k, {chosen(["'[' || y || '] UKSC ' || n", "n || ' U.S. ' || p", "'Art ' || p || ' TFEU'"])} AS normal FROM {BASE}")
def citations_of_jurisdiction(spark, d):
    every = "'[' || y || '] UKSC ' || n || '; ' || n || ' U.S. ' || p || '; Article ' || p || ' TFEU'"
    # Python functions of every branch see every row, so each gets only its own texts
    of = lambda rest, code: citations.citations_of(F.when(F.col("k") % 3 == rest, F.col("text")), only=[code])[0]["normalised"]
    return rows_of(spark, d, text=every).select("k", F.coalesce(of(0, "uk"), of(1, "us"), of(2, "eu")).alias("normal"))


# ---- personal data: a case is a list of plain parts and of (value, placeholder) ----


def hidden(*parts) -> tuple[str, str]:
    both = [p if isinstance(p, tuple) else (p, p) for p in parts]
    return " || ".join(["pre", *[a for a, _ in both], "post"]), " || ".join(["pre", *[b for _, b in both], "post"])


def pii_query(name: str, cases: list[tuple], **options) -> None:
    text, new = (chosen([c[j] for c in cases]) for j in range(2))
    QUERIES[name] = lambda spark, d: rows_of(spark, d, text=text).select("k", pii.anonymised(F.col("text"), **options)["text"].alias("text"))
    SQL[name] = f"SELECT k, {new} AS text FROM {BASE}"


_FOUR = "right(CAST(10000 + n AS STRING), 4)"
pii_query("pii_emails_and_phones", [
    hidden("'write to '", ("lower(a) || n || '@' || lower(b) || '.org'", "'[EMAIL_1]'")), hidden("'call '", (f"'020 7946 ' || {_FOUR}", "'[PHONE_1]'")), hidden("'call '", (f"'(555) 123-' || {_FOUR}", "'[PHONE_1]'"), "' or write to '", ("'x' || n || '@y.com'", "'[EMAIL_1]'")),
    hidden("'write to '", ("'a' || n || '@x.org'", "'[EMAIL_1]'"), "', '", ("'b@x.org'", "'[EMAIL_2]'"), "' and '", ("'A' || n || '@x.org'", "'[EMAIL_1]'")),
])
pii_query("pii_numbers", [
    hidden("'the number '", (f"'078-05-' || {_FOUR}", "'[NATIONAL_ID_1]'")), hidden("'the NHS number: '", (f"'943 476 ' || {_FOUR}", "'[NATIONAL_ID_1]'")), hidden("'sort code '", ("'12-34-' || right(CAST(100 + p AS STRING), 2)", "'[ACCOUNT_NUMBER_1]'")),
    hidden("'the account no. '", (f"'1234' || {_FOUR}", "'[ACCOUNT_NUMBER_1]'")), hidden("'the card '", ("'4111 1111 1111 1111'", "'[ACCOUNT_NUMBER_1]'")), hidden("'in claim '", ("'HC-' || y || '-' || right(CAST(1000000 + n AS STRING), 6)", "'[CASE_NUMBER_1]'")),
    hidden("'paid to '", ("'GB82 WEST 1234 5698 7654 32'", "'[ACCOUNT_NUMBER_1]'")),
])
pii_query("pii_dates_and_money", [
    hidden("'on '", ("(p % 28 + 1) || ' May ' || y", "'[DATE_1]'")), hidden("'on '", ("y || '-05-' || right(CAST(101 + p % 28 AS STRING), 2)", "'[DATE_1]'")), hidden("'it cost '", ("'£' || n || ',250.50'", "'[MONEY_1]'"), "' and then '", ("p || ' million euros'", "'[MONEY_2]'")),
    hidden("'on '", ("'3rd June ' || y", "'[DATE_1]'"), "' it cost '", ("'$' || n", "'[MONEY_1]'"), "' there'"), hidden("'the ' || y || ' edition'"),
])
pii_query("pii_addresses", [
    hidden("'lives at '", ("(n % 97 + 1) || ' High Street'", "'[ADDRESS_1]'"), "', Leeds '", ("'LS1 4AP'", "'[ADDRESS_2]'")), hidden("'lives at '", ("(n % 97 + 1) || ' ' || a || ' Quay'", "'[ADDRESS_1]'")), hidden("'lives at '", ("(n % 97 + 1) || ' Mill Yard'", "'[ADDRESS_1]'")),
    hidden("'before ' || p || ' Commercial Court judges'"), hidden("'the 2019 High Court judgment'"),
])
pii_query("pii_persons", [
    hidden("'then '", ("'Mr John ' || a", "'[PERSON_1]'"), "' rose'"), hidden("'then '", ("'Mrs ' || a || '-' || b", "'[PERSON_1]'"), "' KC rose'"), hidden("'then Mr Justice ' || a || ' rose'"), hidden("'then '", ("'Dr Ann ' || a", "'[PERSON_1]'"), "' met '", ("'Ms Eve ' || b", "'[PERSON_2]'"), "' there'"),
    hidden("'then '", ("'Ms Ana de la ' || a", "'[PERSON_1]'"), "' left'"), hidden("'then '", ("'Mr Ian ' || a", "'[PERSON_1]'"), "' and '", ("'MR IAN ' || upper(a)", "'[PERSON_1]'"), "' left'"),
])
pii_query("pii_organisations", [
    hidden("'yesterday '", ("a || ' Trading Ltd'", "'[ORGANISATION_1]'"), "' paid'"), hidden("'the Finance Director of '", ("a || ' Foods plc'", "'[ORGANISATION_1]'"), "' paid'"), hidden("'then '", ("'Bank of ' || a || ' plc'", "'[ORGANISATION_1]'"), "' paid'"),
    hidden("'then '", ("a || ' Ltd'", "'[ORGANISATION_1]'"), "' met '", ("b || 's LLP'", "'[ORGANISATION_2]'"), "' there'"), hidden("'then the Privy Council Ltd sat'"),
])
pii_query("pii_cited_names_stay", [
    hidden("a || ' v ' || b || ' Ltd [' || y || '] UKSC ' || n"), hidden("'section ' || n || ' of the ' || a || ' Act ' || y || ' binds '", ("b || ' Trading Ltd'", "'[ORGANISATION_1]'")),
])
pii_query("pii_dates_kept", [hidden("'from '", ("'a' || n || '@x.org'", "'[EMAIL_1]'"), "' on 3 May ' || y"), hidden("'on 4 June ' || y || ' it cost '", ("'£' || n", "'[MONEY_1]'"), "' there'")], keep_dates=True)
pii_query("pii_some_types", [hidden("'from a' || n || '@x.org on '", ("'3 May ' || y", "'[DATE_1]'")), hidden("'Mr John ' || a || ' came on '", ("'4 June ' || y", "'[DATE_1]'"))], types=("date",))
pii_query("pii_not_consistent", [hidden("'from '", ("'a' || n || '@x.org'", "'[EMAIL_1]'"), "' to '", ("'a' || n || '@x.org'", "'[EMAIL_2]'"))], consistent=False)
pii_query("pii_own_titles", [hidden("'Then '", ("'Rabbi Ada ' || a", "'[PERSON_1]'"), "' spoke'"), hidden("'Then Lord ' || a || ' spoke'")], titles=(pii.names.TITLES | {"Rabbi"}) - {"Lord"})


@query(f"SELECT k, pre || 'a' || n || '@x.org met Mr John ' || a || ' on 3 May ' || y || post AS text FROM {BASE}")
def pii_pairs_restored(spark, d):
    rows = rows_of(spark, d, text="pre || 'a' || n || '@x.org met Mr John ' || a || ' on 3 May ' || y || post").withColumn("p", pii.training_pairs(F.col("text")))
    back = F.aggregate(F.map_entries("p.reverse"), F.col("p.text"), lambda t, e: F.replace(t, e["key"], e["value"]))
    return rows.select("k", back.alias("text"))


_IBAN = "lpad(CAST(k AS STRING), 14, '0')"


@query(f"SELECT k, (('32142829' || {_IBAN} || '1611' || lpad((k % 100)::VARCHAR, 2, '0'))::HUGEINT % 97 = 1) AS valid FROM {BASE}".replace("STRING", "VARCHAR"))
def iban_checks(spark, d):
    return rows_of(spark, d, text=f"'GB' || lpad(CAST(k % 100 AS STRING), 2, '0') || 'WEST' || {_IBAN}").select("k", pii.iban_check(F.col("text")).alias("valid"))


@query(
    f"SELECT k, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN substr(t, i::INT, 1)::INT ELSE 2 * substr(t, i::INT, 1)::INT - 9 * (substr(t, i::INT, 1)::INT > 4)::INT END)) % 10 = 0 AS valid "
    f"FROM (SELECT k, '4111' || lpad((k * 7919)::VARCHAR, 12, '0') AS t FROM {BASE})"
)
def luhn_checks(spark, d):
    return rows_of(spark, d, text="'4111' || lpad(CAST(k * 7919 AS STRING), 12, '0')").select("k", pii.luhn_check(F.col("text")).alias("valid"))


# ---- chunks: texts of so many parts of a known size ----


def chunk_query(name: str, text: str, sql: dict[str, str], columns: Callable[[Column, Column], dict[str, Column]], **options) -> None:
    def run(spark, d):
        made = rows_of(spark, d, text=text).withColumn("c", chunks.chunks_of(F.col("text"), **options))
        return made.select("k", *[c.alias(n) for n, c in columns(F.col("c"), F.col("text")).items()])

    QUERIES[name], SQL[name] = run, f"SELECT k, {', '.join(f'{e} AS {n}' for n, e in sql.items())} FROM {BASE}"


_count = lambda c, t: {"n_chunks": F.size(c)}
_PARAGRAPH = "repeat('word ', 30) || 'end.'"
chunk_query("chunks_by_paragraph", f"repeat({_PARAGRAPH} || chr(10) || chr(10), CAST(p % 6 + 1 AS INT))", {"n_chunks": "(p % 6 + 1)::INT"}, _count, size=40, overlap=0, least=0)
chunk_query("chunks_packed", f"repeat({_PARAGRAPH} || chr(10) || chr(10), CAST(p % 6 + 1 AS INT))", {"n_chunks": "((p % 6) // 2 + 1)::INT"}, _count, size=80, overlap=0, least=0)
chunk_query("chunks_by_sentence", "repeat('This is a sentence of words. ', CAST(p + 4 AS INT))", {"n_chunks": "((p + 3) // 5 + 1)::INT"}, _count, size=40, overlap=0, least=0)
chunk_query("chunks_by_section", f"'PART 1' || chr(10) || {_PARAGRAPH} || chr(10) || 'PART 2' || chr(10) || {_PARAGRAPH}", {"first": "'PART 1'", "last": "'PART 2'"}, lambda c, t: {"first": c[0]["section"], "last": F.element_at(c, -1)["section"]}, size=50, overlap=0, least=0)
chunk_query("chunk_markers", f"'(' || chr(CAST(97 + k % 9 AS INT)) || ') ' || {_PARAGRAPH}", {"marker": "'(' || chr((97 + k % 9)::INT) || ')'"}, lambda c, t: {"marker": c[0]["paragraph"]}, size=60, overlap=0, least=0)
chunk_query("chunks_overlap", f"repeat({_PARAGRAPH} || chr(10) || chr(10), CAST(p % 4 + 2 AS INT))", {"n_chunks": "(p % 4 + 2)::INT", "meet": "true", "sliced": "true"}, lambda c, t: {"n_chunks": F.size(c), "meet": F.forall(F.slice(F.zip_with(c, F.slice(c, 2, 1000), lambda x, y: F.coalesce(y["start_char"] < x["end_char"], F.lit(True))), 1, 1000), lambda x: x), "sliced": F.forall(c, lambda x: F.substr(t, x["start_char"] + 1, x["end_char"] - x["start_char"]) == x["text"])}, size=50, overlap=10, least=0)
chunk_query("chunks_small_joined", f"{_PARAGRAPH} || chr(10) || chr(10) || 'Short end.'", {"n_chunks": "1"}, _count, size=60, overlap=0, least=20)


# ---- measures of answers ----

_TURNS = "(SELECT a.conv_id, a.turn, a.text AS a, b.text AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
_WORDS = r"regexp_extract_all(lower({0}), '[\pL\pM\pN_]+')"


def _turns(spark, d) -> DataFrame:
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.alias("x").join(c.alias("y"), (F.col("x.conv_id") == F.col("y.conv_id")) & (F.col("y.turn") == F.col("x.turn") + 1)).select("x.conv_id", "x.turn", F.col("x.text").alias("a"), F.col("y.text").alias("b"))


_LCS = f"""WITH RECURSIVE t AS (SELECT conv_id, turn, {_WORDS.format("a")} AS x, {_WORDS.format("b")} AS y FROM {_TURNS}),
r(conv_id, turn, x, y, i, line) AS (
  SELECT conv_id, turn, x, y, 0, list_transform(y, lambda v: 0) FROM t
  UNION ALL
  SELECT conv_id, turn, x, y, i + 1, list_transform(range(1, len(y) + 1), lambda j: list_max(c[1:j]))
  FROM (SELECT *, list_transform(range(1, len(y) + 1), lambda j: greatest(line[j], CASE WHEN y[j] = x[i + 1] THEN coalesce(line[j - 1], 0) + 1 ELSE 0 END)) AS c FROM r WHERE i < len(x))
), l AS (SELECT conv_id, turn, len(x) AS n, len(y) AS m, coalesce(list_max(line), 0) AS s FROM r WHERE i = len(x))
"""


@query(_LCS + "SELECT conv_id, turn, CASE WHEN n = 0 OR m = 0 OR s = 0 THEN 0.0 ELSE 2 * (s / n) * (s / m) / (s / n + s / m) END::DOUBLE AS f1 FROM l")
def rouge_l(spark, d):
    return _turns(spark, d).select("conv_id", "turn", metrics.rouge_l(F.col("a"), F.col("b"))["f1"].alias("f1"))


@query(
    f"SELECT conv_id, turn, n / len(list_distinct(x)) AS p, n / len(list_distinct(y)) AS r, (SELECT count(*) FROM (SELECT DISTINCT unnest(list_transform(range(1, len(x)), lambda i: [x[i], x[i + 1]])) AS g INTERSECT SELECT DISTINCT unnest(list_transform(range(1, len(y)), lambda i: [y[i], y[i + 1]])) AS g)) AS bigrams "
    f"FROM (SELECT *, len(list_intersect(list_distinct(x), list_distinct(y))) AS n FROM (SELECT *, {_WORDS.format('a')} AS x, {_WORDS.format('b')} AS y FROM {_TURNS}) WHERE len(x) > 0 AND len(y) > 0)"
)
def word_overlap(spark, d):
    rows = _turns(spark, d).filter(F.col("a").rlike(r"(?U)[\w]") & F.col("b").rlike(r"(?U)[\w]")).withColumn("s", metrics.similarity(F.col("a"), F.col("b")))
    return rows.select("conv_id", "turn", F.col("s.word_precision").alias("p"), F.col("s.word_recall").alias("r"), F.col("s.bigram_overlap").cast("long").alias("bigrams"))


_ANSWERS = ["'Perhaps it may be so. It seems so. In conclusion, yes!'", "'First, the ' || a || ' point.' || chr(10) || '1. One' || chr(10) || '2. Two'", "'A plain answer about ' || a || '.'"]


@query(f"SELECT k, {chosen(['11', '8', '5'])}::INT AS words, {chosen(['3', '4', '1'])}::INT AS sentences, {chosen(['true', 'true', 'false'])} AS structured FROM {BASE}")
def answer_structure(spark, d):
    return rows_of(spark, d, text=chosen(_ANSWERS)).withColumn("q", metrics.quality(F.col("text"))).select("k", F.col("q.word_count").alias("words"), F.col("q.sentence_count").alias("sentences"), F.col("q.has_structure").alias("structured"))


# ---- benchmark tasks: summaries of answers that depend on k ----


def _records(spark, d, response: list[str], **more: Column) -> DataFrame:
    return rows_of(spark, d, response=chosen(response)).select("k", "response", *[c.alias(n) for n, c in more.items()])


_CITED = ["'It is [' || y || '] UKSC ' || n", "'It is [' || y || '] UKSC ' || n || ' or [1999] UKHL ' || p", "'It is nowhere'"]


@query(f"SELECT avg({chosen(['1.0', '0.5', '0.0'])})::DOUBLE AS precision, avg({chosen(['1.0', '1.0', '0.0'])})::DOUBLE AS recall, avg({chosen(['1.0', '2 / 3', '0.0'])})::DOUBLE AS f1, count(*) AS samples FROM {BASE}")
def task_citation_accuracy(spark, d):
    rows = _records(spark, d, _CITED, text=F.lit("Which case?"), citations=F.array(F.expr("'[' || y || '] uksc ' || n")))
    out = benchmark.citation_accuracy(rows)[1].drop("grounding_rate")
    return out.select(*[F.round(c, 9).alias(c) if c != "samples" else F.col(c) for c in out.columns])


@query(f"SELECT round(avg({chosen(['1.0', '0.5', '1.0'])}), 9)::DOUBLE AS rate FROM {BASE}")
def task_grounding(spark, d):
    rows = _records(spark, d, _CITED, text=F.lit("Which case?"), citations=F.array(F.expr("'[' || y || '] uksc ' || n")), context=F.expr("'We follow [' || y || '] UKSC ' || n || '.'"))
    return benchmark.citation_accuracy(rows)[1].select(F.round("grounding_rate", 9).alias("rate"))


@query(f"SELECT round(avg({chosen(['1.0', '0.0', '0.5'])}), 9)::DOUBLE AS word_f1, count(*) AS samples FROM {BASE}")
def task_summaries(spark, d):
    rows = _records(spark, d, ["'one two three four'", "'five six'", "'one two five six'"], document=F.lit("x"), summary=F.lit("one two three four"))
    return benchmark.case_summarization(rows)[1].select(F.round("word_f1", 9).alias("word_f1"), "samples")


@query(f"SELECT k, {chosen(["'Contract:' || chr(10) || 'the ' || a || ' lease' || chr(10) || chr(10) || 'Question: How long?' || chr(10) || chr(10) || 'Answer:'"])} AS prompt FROM {BASE}")
def task_prompts(spark, d):
    rows = rows_of(spark, d, context="'the ' || a || ' lease'").withColumn("question", F.lit("How long?"))
    return rows.select("k", benchmark.prompt(rows, "contract_qa").alias("prompt"))


@query(f"SELECT k FROM {BASE} WHERE k % 4 IN (1, 2, 3)")
def task_invalid_records(spark, d):
    rows = rows_of(spark, d, question="CASE WHEN k % 4 <> 1 THEN 'How long?' END", context="'the lease'").withColumn("answers", F.expr("CASE k % 4 WHEN 2 THEN array() WHEN 3 THEN array(' ') ELSE array('a year') END"))
    return benchmark.invalid(rows, "contract_qa").select("k")


# ---- jurisdictions, training ----


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("SELECT k, k % 2 = 0 AS is_term FROM " + BASE)
def legal_terms(spark, d):
    terms = F.array(*[F.lit(t) for t in sorted(fixed.JURISDICTION_TERMS["uk"])])
    word = F.when(F.col("k") % 2 == 0, F.initcap(F.get(terms, (F.col("k") % F.size(terms)).cast("int")))).otherwise(F.col("a"))
    return rows_of(spark, d).select("k", jurisdiction("uk").legal_term(word).alias("is_term"))


@query("SELECT k, list_position(c, c[(k % len(c) + 1)::INT]) - 1 AS level FROM (SELECT k, " + _sql_list(fixed.COURT_RANKS["eu"]) + f" AS c FROM {BASE})")
def court_ranks(spark, d):
    courts = F.array(*[F.lit(c) for c in fixed.COURT_RANKS["eu"]])
    return rows_of(spark, d).select("k", jurisdiction("eu").court_level(F.get(courts, (F.col("k") % F.size(courts)).cast("int"))).cast("long").alias("level"))


@query(f"SELECT k, n * 1000000000 AS parameters, n * 1e9 * 2 / 1073741824 + 4 + 0.125 AS lora_gb, n * 1e9 * 16 / 1073741824 + 0.125 AS full_gb FROM {BASE}")
def memory_by_method(spark, d):
    rows = rows_of(spark, d, model="'org/Model-' || n || 'B-chat'")
    return rows.select("k", training.parameters(F.col("model")).alias("parameters"), training.memory(F.col("model"), "lora")["total_gb"].alias("lora_gb"), training.memory(F.col("model"), "full")["total_gb"].alias("full_gb"))


@query(f"SELECT k, {chosen(["'q_proj,k_proj,v_proj,o_proj,gate_proj,up_proj,down_proj'", "'query_key_value,dense,dense_h_to_4h,dense_4h_to_h'", "'c_attn,c_proj,c_fc'", "'all-linear'"])} AS modules FROM {BASE}")
def adapted_modules(spark, d):
    return rows_of(spark, d, model=chosen(["'Llama-' || n", "'Falcon-' || n", "'gpt2-' || a", "'own-' || b"])).select("k", F.array_join(training.target_modules(F.col("model")), ",").alias("modules"))


# ---- datasets ----


def _samples(spark, d) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    none = F.lit(None).cast("string")
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("pos"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.lit("")).alias("text"), F.when(F.col("turn") % 2 == 1, F.col("text")).alias("instruction"), F.when(F.col("turn") % 2 == 1, F.col("role")).alias("response"),
        F.when(F.col("turn") % 3 == 0, "case").otherwise("statute").alias("document_type"), none.alias("jurisdiction"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("source"), F.create_map().cast("map<string,string>").alias("metadata"),
    )


@query("SELECT count(*) AS num_samples, sum((turn % 2 = 1 AND text <> '')::INT)::BIGINT AS num_instructions FROM conversations")
def instruction_counts(spark, d):
    return dataset.statistics(_samples(spark, d)).select("num_samples", "num_instructions")


@query("SELECT CASE WHEN turn % 3 = 0 THEN 'case' ELSE 'statute' END AS document_type, count(*) AS n FROM conversations GROUP BY 1")
def statistics_by_type(spark, d):
    return dataset.statistics(_samples(spark, d)).select(F.explode("document_types").alias("document_type", "n"))


@query("SELECT conv_id * 1000 + turn AS pos FROM conversations ORDER BY 1 LIMIT 20 OFFSET 10")
def rows_between(spark, d):
    return dataset.between(_samples(spark, d), 10, 30).select("pos")


@query("SELECT max(conv_id * 1000 + turn) AS pos FROM conversations")
def last_row(spark, d):
    return dataset.at(_samples(spark, d), -1).select("pos")


@query("SELECT max(conv_id * 1000 + turn) * 2 + 1 - min(conv_id * 1000 + turn) AS last, count(*) * 2 AS n FROM conversations")
def extended_rows(spark, d):
    rows = _samples(spark, d)
    return dataset.extended(rows, rows).agg(F.max("pos").alias("last"), F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT conv_id * 1000 + turn) AS distinct_rows, true AS moved FROM conversations")
def shuffled_rows(spark, d):
    rows = dataset.shuffled(_samples(spark, d), seed=7).select("pos").withColumn("at", F.monotonically_increasing_id())
    return rows.agg(F.count("*").alias("n"), F.count_distinct("pos").alias("distinct_rows"), (F.abs(F.corr("pos", "at")) < 0.5).alias("moved"))


@query(f"SELECT conv_id * 1000 + turn AS pos, CASE WHEN turn % 2 = 1 AND text <> '' THEN '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || role || '<|im_end|>' WHEN turn % 2 = 1 THEN '' ELSE text END AS text FROM conversations")
def training_texts(spark, d):
    return _samples(spark, d).select("pos", prompts.training_text(F.col("text"), F.col("instruction"), F.col("response"), "chatml").alias("text"))


@query("SELECT conv_id * 1000 + turn AS pos, 'system: Be brief|user: ' || text || '|assistant: ' || role AS said FROM conversations WHERE turn % 2 = 1 AND text <> ''")
def training_messages(spark, d):
    rows = _samples(spark, d).filter(prompts.is_instruction(F.col("instruction"), F.col("response")))
    turns = prompts.messages(F.col("text"), F.col("instruction"), F.col("response"), "Be brief")
    return rows.select("pos", F.array_join(F.transform(turns, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "|").alias("said"))


@query("SELECT conv_id * 1000 + turn AS pos FROM conversations WHERE NOT (turn % 2 = 1 AND text <> '') AND turn % 2 = 0 AND length(text) > 40")
def too_long_rows(spark, d):
    return dataset.too_long(_samples(spark, d), 10).select("pos")


@query(f"SELECT k, {chosen(["pre || '[' || y || '] UKSC ' || n || post", "pre || 'no case' || post"])} AS processed, (k % 2 = 0)::INT AS n_citations FROM {BASE}")
def processed_documents(spark, d):
    rows = rows_of(spark, d, text=chosen(["pre || '[' || y || ']   uksc ' || n || post || '   '", "pre || 'no    case' || post || chr(10) || chr(10)"]))
    out = dataset.processing_statistics(dataset.processed(rows))
    return out.select("k", "processed", F.col("statistics.citation_count").alias("n_citations"))


@query(f"SELECT k, {chosen(["pre || 'a case'", "pre || '[EMAIL_1] wrote'"])} || post AS text, {chosen(["'0'", "'0'"])} AS citation_count, 'uk' AS jurisdiction FROM {BASE}")
def preprocessed_samples(spark, d):
    none = F.lit(None).cast("string")
    rows = rows_of(spark, d, text=chosen(["pre || 'a   case' || post", "pre || 'a' || n || '@x.org  wrote' || post"])).select("k", F.col("k").alias("pos"), "text", none.alias("instruction"), none.alias("response"), F.lit("case").alias("document_type"), none.alias("jurisdiction"), none.alias("source"), F.create_map().cast("map<string,string>").alias("metadata"))
    return dataset.preprocessed(rows, jurisdiction="uk").select("k", "text", F.element_at("metadata", "citation_count").alias("citation_count"), "jurisdiction")


@query(f"SELECT k, i AS chunk_index, p % 6 + 1 AS chunk_count FROM {BASE}, range(0, 6) t(i) WHERE i <= p % 6")
def chunked_samples(spark, d):
    none = F.lit(None).cast("string")
    rows = rows_of(spark, d, text=f"repeat({_PARAGRAPH} || chr(10) || chr(10), CAST(p % 6 + 1 AS INT))").select("k", F.col("k").alias("pos"), "text", none.alias("instruction"), none.alias("response"), F.lit("case").alias("document_type"), none.alias("jurisdiction"), none.alias("source"), F.create_map().cast("map<string,string>").alias("metadata"))
    out = dataset.chunked(rows, size=40, overlap=0, least=0)
    return out.select("k", *[F.element_at("metadata", c).cast("long").alias(c) for c in ("chunk_index", "chunk_count")])
