"""python -m lexloom.cli: preprocess, anonymise, citations, train (the data that a trainer reads), evaluate and info. Exit codes: 0, 1 after an error, 130 if interrupted."""

from __future__ import annotations

import argparse
import json
import sys
from collections import Counter
from dataclasses import asdict
from pathlib import Path


def _text(source: str, literal: bool) -> str:
    if source == "-":
        return sys.stdin.read()
    try:
        if Path(source).is_file():
            return Path(source).read_text(encoding="utf-8")
    except OSError:
        pass
    if literal:
        return source
    raise FileNotFoundError(source)


def _put(text: str, path: str | None) -> None:
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text + "\n", encoding="utf-8")
    else:
        print(text)


def _spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.appName("lexloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def preprocess(args: argparse.Namespace) -> None:
    """Dedup, then clean and anonymise, then chunk, then write or tell statistics."""
    from lexloom.operators import dataset
    from lexloom.sources import corpus

    rows = corpus.load(_spark(), args.source)
    if args.records:
        rows.sparkSession.sparkContext.setLogLevel("ERROR")
        found = dataset.chunk_records(rows, size=args.chunk_size, jurisdiction=args.jurisdiction)
        if args.output:
            found.write.json(args.output)
        else:
            print("\n".join(found.toJSON().toLocalIterator()))
        return
    rows = dataset.deduplicate(rows) if args.dedupe else rows
    options = {"salt": args.salt} if args.salt else {}
    rows = dataset.preprocessed(rows, bool(args.anonymise or args.salt), args.jurisdiction, **options)
    rows = dataset.chunked(rows, size=args.chunk_size, jurisdiction=args.jurisdiction) if args.chunk else rows
    if args.output:
        corpus.write_jsonl(rows, args.output)
    else:
        print(dataset.statistics(rows).toJSON().first())


def anonymise(args: argparse.Namespace) -> None:
    from lexloom.functions import pii

    own = pii.Anonymiser(salt=args.salt)
    text, found = own.anonymise(_text(args.source, True))
    _put(text, args.output)
    if args.mapping:
        _put(json.dumps(pii.inverted(own.mapping), ensure_ascii=False, indent=2), args.mapping)
    for kind, n in sorted(Counter(e.entity_type for e in found).items()):
        print(f"{kind}: {n}", file=sys.stderr)


def find_citations(args: argparse.Namespace) -> None:
    from lexloom.functions import citations

    _, only = citations.checked(only=args.only)
    found = citations.parse(_text(args.source, True), unique=not args.all, only=only)
    _put(json.dumps([asdict(c) for c in found], ensure_ascii=False, indent=2) if args.json else "\n".join(f"{citations.normal_form(c)}\t{c.parties or ''}" for c in found), args.output)


def train(args: argparse.Namespace) -> None:
    """Resolves the settings, tells what the model would need, and writes the rows that a trainer reads, with the settings beside them."""
    from pyspark.sql import functions as F

    from lexloom.functions import training
    from lexloom.operators import dataset
    from lexloom.sources import corpus

    given = training.TrainingConfig.explicit(json.loads(Path(args.config).read_text(encoding="utf-8"))) if args.config else {}
    given |= {k: v for k, v in {"base_model": args.model, "method": args.method, "task": args.task, "train_dataset": args.dataset}.items() if v is not None}
    settings = training.TrainingConfig(**given)
    need = _spark().range(1).select(training.memory(F.lit(settings.base_model), settings.method, settings.batch_size, settings.max_seq_length)["total_gb"].alias("gb")).first().gb
    if args.dry_run:
        _put(json.dumps(settings.to_dict() | {"total_gb": need}, indent=2), args.output)
        return
    samples = corpus.load(_spark(), settings.train_dataset)
    if n := dataset.too_long(samples, settings.max_seq_length).count():
        print(f"{n} documents are longer than {settings.max_seq_length} tokens and would be cut off; chunk them first", file=sys.stderr)
    rows = dataset.training_rows(samples, settings.max_seq_length, settings.anonymise_training_data, settings.jurisdiction, settings.preserve_citations, settings.prompt_template, settings.text_column)
    out = args.output or settings.output_dir
    rows.write.parquet(f"{out}/rows")
    settings.save(f"{out}/settings.json")


def evaluate(args: argparse.Namespace) -> None:
    from lexloom.operators import benchmark
    from lexloom.sources import benchmarks

    results, skipped = benchmark.run(benchmarks.load(_spark(), args.source), max_samples=args.max_samples)
    if args.save:
        benchmark.save(results, args.save, skipped, args.samples)
    table = benchmark.task_metrics({t: sums for t, (_, sums) in results.items()})
    _put(json.dumps({"metrics": [r.asDict() for r in table.collect()], "skipped": skipped}, indent=2), args.output)


def info(args: argparse.Namespace) -> None:
    from pyspark.sql import functions as F

    from lexloom.functions import training

    row = _spark().createDataFrame([(args.model,)], "m string").select(training.parameters(F.col("m")).alias("parameters"), training.memory(F.col("m"), args.method)["total_gb"].alias("total_gb"), training.memory(F.col("m"), args.method)["recommended_gpu"].alias("gpu"), training.target_modules(F.col("m")).alias("modules")).first()
    print(json.dumps(row.asDict(), indent=2))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexloom")
    subs = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, *aliases: str) -> argparse.ArgumentParser:
        sub = subs.add_parser(name, aliases=list(aliases))
        sub.set_defaults(run=run)
        return sub

    p = add("preprocess", preprocess)
    p.add_argument("source")
    for flag in ("--dedupe", "--anonymise", "--chunk"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--records", action="store_true", help="only the chunks: text, source, chunk_index, start_char, end_char, section")
    p.add_argument("--salt")
    p.add_argument("--jurisdiction", default="uk")
    p.add_argument("--chunk-size", type=int, default=512)
    p.add_argument("-o", "--output")
    p = add("anonymise", anonymise, "anonymize")
    p.add_argument("source")
    p.add_argument("--salt")
    p.add_argument("--mapping")
    p.add_argument("-o", "--output")
    p = add("citations", find_citations)
    p.add_argument("source")
    p.add_argument("--only", nargs="*")
    p.add_argument("--all", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("-o", "--output")
    p = add("train", train)
    for flag in ("--config", "--model", "--method", "--task", "--dataset", "-o"):
        p.add_argument(flag, **({"dest": "output"} if flag == "-o" else {}))
    p.add_argument("--dry-run", action="store_true")
    p = add("evaluate", evaluate)
    p.add_argument("source")
    p.add_argument("--save")
    p.add_argument("--samples", action="store_true")
    p.add_argument("--max-samples", type=int)
    p.add_argument("-o", "--output")
    p = add("info", info)
    p.add_argument("model")
    p.add_argument("--method", default="qlora")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run(args)
    except KeyboardInterrupt:
        return 130
    except Exception as error:  # noqa: BLE001 - a command line tells what went wrong and ends
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
