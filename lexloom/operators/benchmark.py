"""Benchmark tasks: records with answers to scores a row, and one aggregation a task.

records have the task's columns and ``response``. Answers come from a column or, by answered(), from a function.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import metrics as M
from lexloom.functions.prompts import instruction_format

TASKS = ("citation_accuracy", "legal_reasoning", "contract_qa", "case_summarization", "legal_ner", "clause_classification")
#: Alternatives of which a record needs one, and lists that may hold no empty text.
REQUIRED = {
    "citation_accuracy": (("prompt", "text", "question"), ("citations",)), "legal_reasoning": (("prompt", "question"),), "contract_qa": (("question",), ("answers",)),
    "case_summarization": (("document", "text"), ("summary",)), "legal_ner": (("text",), ("entities",)), "clause_classification": (("text",), ("label",)),
}
LISTS = {"citation_accuracy": "citations", "contract_qa": "answers"}


def first_of(df: DataFrame, *names: str) -> Column:
    return F.coalesce(*[F.col(n).cast("string") for n in names if n in df.columns], F.lit(""))


def invalid(records: DataFrame, task: str) -> DataFrame:
    """The records that lack a required field or hold an empty list or text where one is needed."""
    none = [reduce(Column.__and__, [F.col(n).isNull() if n in records.columns else F.lit(True) for n in names]) for names in REQUIRED[task]]
    bad = reduce(Column.__or__, none)
    if (name := LISTS.get(task)) in records.columns:
        bad = bad | (F.size(name) == 0) | F.exists(name, lambda x: x.isNull() | (F.trim(x) == ""))
    return records.filter(F.coalesce(bad, F.lit(True)))


def checked(records: DataFrame, task: str) -> DataFrame:
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}: one of {', '.join(TASKS)}")
    if n := invalid(records, task).limit(1).count():
        raise ValueError(f"{task}: at least {n} record lacks what it needs ({REQUIRED[task]})")
    return records


def prompt(df: DataFrame, task: str, options: str = "options", labels: str = "labels", template: str | None = None) -> Column:
    """The prompt of a record: the user's message (template "messages"), a training template's text up to the answer, or plain."""
    context = first_of(df, "context")
    if template is not None:
        asked, given = _asked(df, task, options, labels)
        if template == "messages":
            return F.when(given != "", F.concat(asked, F.lit("\n\n"), given)).otherwise(asked)
        return instruction_format(asked, context=F.nullif(given, F.lit("")), template=template)
    lines = lambda *parts: F.concat_ws("\n\n", *parts)
    if task == "contract_qa":
        return lines(F.concat(F.lit("Contract:\n"), context), F.concat(F.lit("Question: "), F.col("question")), F.lit("Answer:"))
    if task == "case_summarization":
        return lines(F.lit("Summarise the following legal document:"), first_of(df, "document", "text"), F.lit("Summary:"))
    if task == "legal_ner":
        known = F.array_join(F.col(labels), ", ") if labels in df.columns else F.lit("any")
        return lines(F.concat(F.lit("List the entities of these kinds, one on a line as LABEL: text. Kinds: "), known), F.col("text"), F.lit("Entities:"))
    if task == "clause_classification":
        known = F.array_join(F.col(options), ", ") if options in df.columns else F.lit("any")
        return lines(F.concat(F.lit("Name the kind of this clause. Kinds: "), known), F.col("text"), F.lit("Kind:"))
    question = first_of(df, "prompt", "text", "question") if task == "citation_accuracy" else first_of(df, "prompt", "question")
    return F.when(context != "", lines(context, question)).otherwise(question)


def _asked(df: DataFrame, task: str, options: str, labels: str) -> tuple[Column, Column]:
    """What is asked, and the text that it is asked about."""
    kinds = lambda c: F.array_join(F.col(c), ", ") if c in df.columns else F.lit("any")
    fixed = {
        "case_summarization": lambda: (F.lit("Summarise the following legal document."), first_of(df, "document", "text")),
        "legal_ner": lambda: (F.concat(F.lit("List the entities of these kinds, one on a line as LABEL: text. Kinds: "), kinds(labels)), F.col("text")),
        "clause_classification": lambda: (F.concat(F.lit("Name the kind of this clause. Kinds: "), kinds(options)), F.col("text")),
    }
    names = ("prompt", "text", "question") if task == "citation_accuracy" else ("prompt", "question")
    return fixed[task]() if task in fixed else (first_of(df, *names), first_of(df, "context"))


def answered(records: DataFrame, task: str, generate: Callable[[str], str], template: str | None = None) -> DataFrame:
    """records with ``response`` by a function of the prompt; all are checked before any is asked."""
    ask = F.pandas_udf(lambda texts: texts.map(generate), "string")
    return checked(records, task).withColumn("response", ask(prompt(records, task, template=template)))


def _mean(**scores: Column) -> list[Column]:
    return [F.coalesce(F.avg(c.cast("double")), F.lit(0.0)).alias(n) for n, c in scores.items()]


def citation_accuracy(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row per record, means of precision, recall and f1; grounding over rows with a context)."""
    rows = records.withColumns({"found": M.normal_citations(F.col("response")), "wanted": M.canonical(F.col("citations"))})
    rows = rows.withColumn("s", M.citation_scores(F.col("found"), F.col("wanted"))).select("*", "s.*").drop("s")
    context = first_of(records, "context")
    rows = rows.withColumn("grounding_rate", F.when(context != "", M.grounding(F.col("found"), context)["grounding_rate"]))
    return rows, rows.agg(*_mean(precision=F.col("precision"), recall=F.col("recall"), f1=F.col("f1")), F.avg("grounding_rate").alias("grounding_rate"), F.count("*").alias("samples"))


def legal_reasoning(records: DataFrame, jurisdiction: str = "uk") -> tuple[DataFrame, DataFrame]:
    """(rows with aggregate, its mean, least and most)."""
    reference, context = first_of(records, "reference", "answer"), first_of(records, "context")
    found = M.normal_citations(F.col("response"))
    f1 = F.when(F.col("citations").isNotNull(), M.citation_scores(found, M.canonical(F.coalesce("citations", F.array().cast("array<string>"))))["f1"]) if "citations" in records.columns else F.lit(None).cast("double")
    ground = F.when(context != "", M.grounding(found, context)["grounding_rate"])
    like = F.when(reference != "", M.similarity(F.col("response"), reference)["word_f1"])
    rows = records.withColumn("aggregate", M.overall(M.terminology(F.col("response"), jurisdiction)["terminology_density"], f1, ground, like))
    return rows, rows.agg(F.avg("aggregate").alias("mean"), F.min("aggregate").alias("least"), F.max("aggregate").alias("most"), F.count("*").alias("samples"))


def contract_qa(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with correct, partial and token_f1, their means)."""
    answer = F.col("response")
    exact = F.exists("answers", lambda a: (M.phrase(a) != "") & M.has_phrase(answer, a) | (M.phrase(a) == ""))
    shares = F.exists("answers", lambda a: F.exists(M.tokens(a), lambda w: (F.length(w) > 3) & F.array_contains(M.tokens(answer), w)))
    best = F.array_max(F.transform("answers", lambda a: M.token_f1(answer, a)))
    rows = records.withColumns({"correct": exact, "partial": exact | shares, "token_f1": best})
    return rows, rows.agg(*_mean(exact_accuracy=F.col("correct").cast("int"), partial_accuracy=F.col("partial").cast("int"), token_f1=F.col("token_f1")), F.count("*").alias("samples"))


def case_summarization(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = records.withColumns({"word_f1": M.similarity(F.col("response"), F.col("summary"))["word_f1"], "rouge_l": M.rouge_l(F.col("response"), F.col("summary"))["f1"]})
    return rows, rows.agg(*_mean(word_f1=F.col("word_f1"), rouge_l=F.col("rouge_l")), F.count("*").alias("samples"))


def _entity(label: Column, text: Column) -> Column:
    plain = F.regexp_replace(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), r"^[\"'“‘”’.,;]+|[\"'“‘”’.,;]+$", "")
    return F.concat(F.replace(F.upper(F.trim(label)), F.lit(" "), F.lit("_")), F.lit("\x1f"), F.lower(plain))


def legal_ner(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with hits, made and wanted, precision, recall and f1 over all of them). Labels count that some record's entities bear."""
    gold = F.array_distinct(F.transform("entities", lambda e: _entity(e["label"], e["text"])))
    labels = records.select(F.explode("entities").alias("e")).select(F.replace(F.upper("e.label"), F.lit(" "), F.lit("_")).alias("l")).distinct().agg(F.collect_set("l").alias("ls"))
    line = r"(?m)^[ \t]*(?:[-*•]|\d+[.)])?[ \t]*([A-Za-z][A-Za-z _]*):[ \t]*(\S.*?)[ \t]*$"
    said = F.zip_with(F.regexp_extract_all("response", F.lit(line), F.lit(1)), F.regexp_extract_all("response", F.lit(line), F.lit(2)), _entity)
    rows = records.withColumn("ls", labels.scalar()).withColumns({"gold": gold, "said": F.array_distinct(said)})
    rows = rows.withColumn("said", F.filter("said", lambda s: F.array_contains(F.col("ls"), F.substring_index(s, "\x1f", 1)))).drop("ls")
    rows = rows.withColumns({"hits": F.size(F.array_intersect("gold", "said")), "made": F.size("said"), "wanted": F.size("gold")})
    sums = rows.agg(F.sum("hits").cast("double").alias("h"), F.sum("made").alias("m"), F.sum("wanted").alias("w"), F.count("*").alias("samples"))
    p, r = F.when(F.col("m") > 0, F.col("h") / F.col("m")).otherwise(0.0), F.when(F.col("w") > 0, F.col("h") / F.col("w")).otherwise(0.0)
    return rows, sums.select(p.alias("precision"), r.alias("recall"), M.harmonic(p, r).alias("f1"), "samples")


def clause_classification(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with predicted and correct, accuracy). Without options a record is right if its label's words are in the answer."""
    options = F.col("options") if "options" in records.columns else F.lit(None).cast("array<string>")
    has = F.coalesce(F.size(options) > 0, F.lit(False))
    rows = records.withColumn("predicted", F.when(has, M.chosen_option(F.col("response"), options)))
    right = F.when(has, F.coalesce(M.phrase(F.col("predicted")) == M.phrase(F.col("label")), F.lit(False))).otherwise(M.has_phrase(F.col("response"), F.col("label")))
    rows = rows.withColumn("correct", right)
    return rows, rows.agg(*_mean(accuracy=F.col("correct").cast("int")), F.count("*").alias("samples"))


EVALUATORS = {f.__name__: f for f in (citation_accuracy, legal_reasoning, contract_qa, case_summarization, legal_ner, clause_classification)}


def task_metrics(results: dict[str, DataFrame]) -> DataFrame:
    """task, metric, value, samples from the aggregates of tasks."""
    parts = [df.unpivot(["samples"], [c for c in df.columns if c != "samples"], "metric", "value").select(F.lit(t).alias("task"), "metric", "value", "samples") for t, df in results.items()]
    return reduce(DataFrame.unionByName, parts).filter("value is not null")


def suite_summary(metrics: DataFrame) -> DataFrame:
    """metric, value: unweighted means over tasks."""
    return metrics.groupBy("metric").agg(F.avg("value").alias("value"))


def evaluate(data: dict[str, DataFrame], tasks: tuple[str, ...] = TASKS, max_samples: int | None = None, generate: Callable[[str], str] | None = None, template: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(task metrics, tasks left out with the reason). All tasks are checked before any is run."""
    results, skipped = run(data, tasks, max_samples, generate, template)
    return task_metrics({t: sums for t, (_, sums) in results.items()}), skipped


def run(data: dict[str, DataFrame], tasks: tuple[str, ...] = TASKS, max_samples: int | None = None, generate: Callable[[str], str] | None = None, template: str | None = None) -> tuple[dict[str, tuple[DataFrame, DataFrame]], dict[str, str]]:
    """(task: its rows with scores, and their aggregates; tasks left out with the reason)."""
    if unknown := set(tasks) - set(TASKS):
        raise ValueError(f"unknown tasks {sorted(unknown)}")
    skipped, chosen = {t: "no test data provided" for t in tasks if t not in data}, {}
    for t in tasks:
        if t in data:
            rows = data[t] if max_samples is None else data[t].limit(max_samples)
            if rows.isEmpty():
                skipped[t] = "no samples"
            else:
                chosen[t] = checked(rows, t)
    if not chosen:
        raise ValueError("no task has test data")
    return {t: EVALUATORS[t](answered(d, t, generate, template) if generate else d) for t, d in chosen.items()}, skipped


def save(results: dict[str, tuple[DataFrame, DataFrame]], path: str, skipped: dict[str, str] | None = None, samples: bool = True) -> None:
    """Under the path: ``metrics`` (task, metric, value, samples), ``skipped`` and, if asked for, ``samples/task=...``, all as JSON lines.

    Rows with scores hold the answers, so they are as confidential as the records.
    """
    metrics = task_metrics({t: sums for t, (_, sums) in results.items()})
    metrics.coalesce(1).write.json(f"{path}/metrics")
    spark = metrics.sparkSession
    spark.createDataFrame(list((skipped or {}).items()), "task string, reason string").coalesce(1).write.json(f"{path}/skipped")
    for task, (rows, _) in results.items() if samples else ():
        rows.write.json(f"{path}/samples/task={task}")
