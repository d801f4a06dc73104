"""Benchmark records: a small built-in set, and reading of task files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from lexloom.operators.benchmark import TASKS

SCHEMAS = {
    "citation_accuracy": "prompt string, text string, question string, citations array<string>, context string, response string",
    "legal_reasoning": "prompt string, question string, reference string, answer string, citations array<string>, context string, response string",
    "contract_qa": "question string, answers array<string>, context string, response string",
    "case_summarization": "document string, text string, summary string, response string",
    "legal_ner": "text string, entities array<struct<label:string,text:string>>, labels array<string>, response string",
    "clause_classification": "text string, label string, options array<string>, response string",
}
_KINDS = ["termination", "governing law", "confidentiality", "payment", "liability"]
_BUILT_IN = {
    "citation_accuracy": [
        {"prompt": "Cite the case that set out the neighbour principle.", "citations": ["[1932] AC 562"]}, {"prompt": "Which Act governs the duties of company directors?", "citations": ["Companies Act 2006"]},
        {"prompt": "Cite the leading US case on judicial review.", "citations": ["5 U.S. 137"]}, {"prompt": "Which provision lets data subjects have data erased?", "citations": ["Article 17 GDPR"]},
        {"prompt": "Cite the ruling that gave EU law primacy.", "citations": ["Case 6/64", "ECLI:EU:C:1964:66"]}, {"prompt": "Which section makes theft an offence?", "citations": ["Theft Act 1968, s 1"], "context": "Theft is defined in section 1 of the Theft Act 1968."},
    ],
    "legal_reasoning": [
        {"question": "A shop displays goods with a price. Is that an offer?", "reference": "A display is an invitation to treat; the customer makes the offer at the till."}, {"question": "Can a party rely on a term first shown after payment?", "reference": "No. Terms must be brought to notice before or when the contract is made."},
        {"question": "Does silence amount to acceptance?", "reference": "As a rule silence is not acceptance of an offer."},
    ],
    "contract_qa": [
        {"question": "How long is the notice period?", "answers": ["thirty days", "30 days"], "context": "Either side may end this agreement on thirty days' notice."}, {"question": "Who owns the work?", "answers": ["the client"], "context": "All work belongs to the client once paid for."},
        {"question": "When is payment due?", "answers": ["within 14 days"], "context": "Invoices are paid within 14 days of receipt."}, {"question": "Which law governs?", "answers": ["English law", "the law of England"], "context": "This agreement is governed by English law."},
    ],
    "case_summarization": [
        {"document": "The tenant stopped paying rent after the roof leaked for six months. The landlord sued. The court set the cost of repair off against the rent.", "summary": "A tenant could set repair costs off against unpaid rent."},
        {"document": "A driver hit a parked van while looking at a screen. He said the van stood badly. The judge found him wholly at fault.", "summary": "A distracted driver was wholly at fault for hitting a parked van."},
    ],
    "legal_ner": [
        {"text": "Ms Field sued Harbour Ltd in the High Court.", "entities": [{"label": "PARTY", "text": "Ms Field"}, {"label": "PARTY", "text": "Harbour Ltd"}, {"label": "COURT", "text": "High Court"}]},
        {"text": "Judge Moore gave judgment on 3 May 2021.", "entities": [{"label": "JUDGE", "text": "Judge Moore"}, {"label": "DATE", "text": "3 May 2021"}]}, {"text": "The Court of Appeal allowed the appeal of Dale plc.", "entities": [{"label": "COURT", "text": "Court of Appeal"}, {"label": "PARTY", "text": "Dale plc"}]},
    ],
    "clause_classification": [
        {"text": "Either party may end this agreement on notice.", "label": "termination", "options": _KINDS}, {"text": "This agreement is subject to the law of Scotland.", "label": "governing law", "options": _KINDS}, {"text": "Neither side shall disclose what it learns.", "label": "confidentiality", "options": _KINDS},
        {"text": "Fees fall due on the first of each month.", "label": "payment", "options": _KINDS}, {"text": "Neither side answers for indirect loss.", "label": "liability", "options": _KINDS},
    ],
}


def built_in(spark: SparkSession, task: str) -> DataFrame:
    """The records of a task; none for an unknown one."""
    return spark.createDataFrame([json.loads(json.dumps(r)) for r in _BUILT_IN.get(task, [])], SCHEMAS.get(task, "text string"))


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tasks of a directory (task.jsonl before task.json), or of one JSON object of task to records."""
    if path.endswith(".json"):
        whole = spark.read.option("multiLine", "true").json(path)
        if unknown := set(whole.columns) - set(TASKS):
            raise ValueError(f"unknown tasks {sorted(unknown)}")
        return {t: spark.read.schema(f"{t} array<struct<{SCHEMAS[t].replace(' array', ':array').replace(' string', ':string')}>>").option("multiLine", "true").json(path).selectExpr(f"inline({t})") for t in whole.columns}
    found, hadoop = {}, spark._jvm.org.apache.hadoop.fs.Path
    for task in TASKS:
        for end in ("jsonl", "json"):
            file = hadoop(f"{path.rstrip('/')}/{task}.{end}")
            if file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
                found[task] = spark.read.schema(SCHEMAS[task]).option("multiLine", str(end == "json").lower()).json(file.toString())
                break
    if not found:
        raise ValueError(f"no task files in {path}")
    return found
