import json

from lexloom import cli
from lexloom.operators import benchmark
from lexloom.sources import benchmarks


def test_texts(tmp_path, capsys):
    assert cli.main(["citations", "See A v B [2020] UKSC 1.", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["parties"] == "A v B"
    out, back = tmp_path / "x" / "a.txt", tmp_path / "m.json"
    assert cli.main(["anonymise", "Mr Lee, a@x.org", "-o", str(out), "--mapping", str(back)]) == 0
    assert out.read_text() == "[PERSON_1], [EMAIL_1]\n" and json.loads(back.read_text())["[PERSON_1]"] == "Mr Lee"
    assert cli.main(["citations", "x", "--only", "fr"]) == 1


def test_corpora(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Mr Lee. " * 3)
    (tmp_path / "in" / "b.txt").write_text("mr lee. " * 3)
    assert cli.main(["preprocess", str(tmp_path / "in"), "--dedupe", "--anonymise"]) == 0
    assert json.loads(capsys.readouterr().out)["num_samples"] == 1
    assert cli.main(["preprocess", str(tmp_path / "none.jsonl")]) == 1


def test_training_data_and_suites(spark, tmp_path, capsys):
    (tmp_path / "d.jsonl").write_text('{"instruction": "Q", "output": "A"}\n{"text": "Raw."}\n')
    assert cli.main(["train", "--model", "x-8B", "--task", "contract_review", "--dry-run"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["num_epochs"] == 5 and 5 < told["total_gb"] < 7
    assert cli.main(["train", "--dataset", str(tmp_path / "d.jsonl"), "-o", str(tmp_path / "out")]) == 0
    assert sorted(r.text[-1] for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()) == [".", "A"]
    assert cli.main(["train", "--method", "lora", "--config", str(tmp_path / "out" / "settings.json"), "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out)["optim"] == "adamw_torch"
    assert cli.main(["preprocess", str(tmp_path / "d.jsonl"), "--records"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["source"] == "d.jsonl#2"
    (tmp_path / "contract_qa.jsonl").write_text('{"question": "q", "answers": ["a"], "response": "a"}\n')
    assert cli.main(["evaluate", str(tmp_path), "--save", str(tmp_path / "suite"), "--samples"]) == 0
    assert spark.read.json(str(tmp_path / "suite" / "metrics")).count() == 3 and spark.read.json(str(tmp_path / "suite" / "samples")).first().correct
    assert spark.read.json(str(tmp_path / "suite" / "skipped")).count() == 5


def test_prompts(spark):
    rows = benchmarks.built_in(spark, "contract_qa").limit(1)
    asked = lambda t: rows.select(benchmark.prompt(rows, "contract_qa", template=t).alias("p")).first().p
    assert asked("messages").startswith("How long is the notice period?\n\nEither side") and asked("alpaca").endswith("### Response:\n") and asked(None).endswith("Answer:")
    assert asked("{instruction} | {response}") == "How long is the notice period? | "


def test_built_in_records(spark, tmp_path):
    sizes = {t: benchmarks.built_in(spark, t).count() for t in benchmark.TASKS}
    assert list(sizes.values()) == [6, 3, 4, 2, 3, 5]
    assert all(benchmark.checked(benchmarks.built_in(spark, t), t) is not None for t in benchmark.TASKS)
    (tmp_path / "contract_qa.jsonl").write_text('{"question": "q", "answers": ["a"], "response": "a"}\n')
    table, skipped = benchmark.evaluate(benchmarks.load(spark, str(tmp_path)))
    assert {r.metric: r.value for r in table.collect()}["exact_accuracy"] == 1 and len(skipped) == 5
