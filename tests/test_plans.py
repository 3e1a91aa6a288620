import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from kinweave import cli
from kinweave.functions import text
from kinweave.operators import decide, learning
from kinweave.plans import linkage, runner, store, third
from kinweave.sources import records as sources
from kinweave.streaming import records as streaming


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """Files of three sources and their truth."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(n))
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry"
    out = {1: [head], 2: [head], 3: [head]}
    truth = ["source1_entity_id\tmatched_entity_ids"]
    for i in range(60):
        name, address = f"{word(3)} {word(2)}", f"{rng.randint(1, 99)} {word(2)} Street {word(3)}"
        out[1].append(f"S1-{i}\t{name} Inc\t{address}\tus")
        out[3].append(f"S3-{i}\t{word(3)} {word(2)} LLC\t{rng.randint(1, 99)} {word(2)} Road {word(3)}\tus")
        if i % 3:
            out[2].append(f"S2-{i}\t{name.title()} Incorporated\t{address.replace('Street', 'St')}\tUSA")
        truth.append(f"S1-{i}\t{f'S2-{i}' if i % 3 else ''}")
    root = tmp_path_factory.mktemp("corpus")
    for k, lines in out.items():
        (root / f"s{k}.tsv").write_text("\n".join(lines) + "\n")
    (root / "truth.tsv").write_text("\n".join(truth) + "\n")
    return root


SMALL = {"holdout_frac": 0.5, "n_folds": 2, "trees": 3, "depth": 3, "step": 0.1, "min_rows": 1}


def last_line(capsys):
    return json.loads([x for x in capsys.readouterr().out.strip().splitlines() if x.startswith("{")][-1])


def test_commands_end_to_end(spark, corpus, capsys, monkeypatch):
    monkeypatch.setattr(decide, "rule_grid", lambda: [decide.Rule("threshold", t=0.5), decide.Rule()])
    own = [x for k in (1, 2, 3) for x in (f"--s{k}", str(corpus / f"s{k}.tsv"))]
    truth = ["--truth", str(corpus / "truth.tsv")]
    settings = ["--settings", json.dumps(SMALL)]
    cli.main(["train", *own, *truth, "--out", str(corpus / "model"), *settings])
    model = store.load(spark, str(corpus / "model"))
    assert model.settings.ref_records == 160 and model.settings.trees == 3
    cli.main(["predict", *own, "--model", str(corpus / "model"), "--out", str(corpus / "out"), "--zip", str(corpus / "all.zip")])
    assert set(last_line(capsys).values()) == {0}
    lists = {r[0]: r[1] for r in spark.read.option("sep", "\t").option("header", True).csv(str(corpus / "out/matching_results")).collect()}
    assert len(lists) == 60 and sum(lists[f"S1-{i}"] == f"S2-{i}" for i in range(60) if i % 3) > 30
    with zipfile.ZipFile(corpus / "all.zip") as z:
        lines = z.read("output/matching_results.tsv").decode().splitlines()
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and [x.split("\t")[0] for x in lines[1:]] == [f"S1-{i}" for i in range(60)]
    scores = ["--scores", str(corpus / "out/scores")]
    cli.main(["tune", *scores, *truth, "--write", str(corpus / "model")])
    assert last_line(capsys)["same"]
    cli.main(["stage3", *scores, *truth, "--s1", str(corpus / "s1.tsv"), "--out", str(corpus / "third"), "--min-gain", "-1", "--trees", '{"trees": 3, "depth": 2}'])
    assert last_line(capsys)["accepted"]
    cli.main(["predict", *own, "--model", str(corpus / "model"), "--out", str(corpus / "out3"), "--from-scores", str(corpus / "out/scores"), "--third", str(corpus / "third")])
    assert set(last_line(capsys).values()) == {0}
    cli.main(["loss", *own, *scores, *truth, "--model", str(corpus / "model"), "--out", str(corpus / "errors")])
    assert {"error", "s1_business_name", "tgt_id"} <= set(spark.read.option("sep", "\t").option("header", True).csv(str(corpus / "errors")).columns)
    cli.main(["check-blocking", *own, *truth, "--out", str(corpus / "misses")])
    shown = capsys.readouterr().out
    assert all(f"== {x}" in shown for x in ("cost", "recall", "keys", "reasons", "better", "oversized")) and "%" in shown
    (corpus / "used.txt").write_text("S1-1\tx\n S1-2\n")
    cli.main(["devset", *own, *truth, "--used", str(corpus / "used.txt"), "--out", str(corpus / "dev"), "--share", "1.0"])
    dev = {r[0] for r in spark.read.option("sep", "\t").option("header", True).csv(str(corpus / "dev/dev_source1")).collect()}
    assert len(dev) == 58 and "S1-1" not in dev
    cli.main(["fit-cleaning", *own, *truth, "--out", str(corpus / "state")])
    cli.main(["clean", *own, "--state", str(corpus / "state"), "--out", str(corpus / "cache"), "--preview", "2"])
    assert last_line(capsys) == {"rows": 160} and len(list((corpus / "cache").glob("cleaned-*/part_src=1/part_country=us"))) == 1
    assert spark.read.option("sep", "\t").option("header", True).csv(str(corpus / "cache/preview")).count() == 6
    cli.main(["pairs", *own, *truth, "--out", str(corpus / "pairs"), "--n", "5"])
    assert spark.read.option("sep", "\t").option("header", True).csv(str(corpus / "pairs")).count() == 5


def test_everything_in_one_go_and_resumed(spark, corpus, capsys, monkeypatch):
    monkeypatch.setattr(decide, "rule_grid", lambda: [decide.Rule("threshold", t=0.5)])
    own = [x for k in (1, 2, 3) for x in (f"--s{k}", str(corpus / f"s{k}.tsv"))]
    whole = ["run", *own, "--truth", str(corpus / "truth.tsv"), "--out", str(corpus / "whole"), "--settings", json.dumps(SMALL), "--resume"]
    cli.main(whole)
    assert set(last_line(capsys).values()) == {0}
    cli.main(whole)
    out = capsys.readouterr().out
    assert out.count("there already") == 5 and "state: done" not in out


def test_steps_resume_try_again_and_stop(spark, tmp_path, capsys):
    calls = []

    def fails_once(made):
        calls.append(spark.conf.get("spark.sql.shuffle.partitions"))
        if len(calls) == 1:
            raise RuntimeError("too large")
        return made["a"].selectExpr("id + 1 AS id")

    steps = [("a", lambda made: spark.range(3)), ("b", fails_once)]
    got = runner.run(spark, steps, str(tmp_path))
    assert sorted(r[0] for r in got["b"].collect()) == [1, 2, 3] and int(calls[1]) == 2 * int(calls[0])
    assert spark.conf.get("spark.sql.shuffle.partitions") == calls[0]
    runner.run(spark, steps, str(tmp_path))
    assert len(calls) == 2 and capsys.readouterr().out.count("there already") == 2
    with pytest.raises(TimeoutError):
        runner.run(spark, [("c", steps[0][1])], str(tmp_path), deadline=-1.0)
    assert runner.memory(spark)["jvm"] > 0


def test_repair_with_half_file_backup_and_broken_references(spark, tmp_path, capsys):
    (tmp_path / "main1.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tAcme\t1 Main St,\nSpringfield\tUS\nS1-2\tBolt\t2 Main St India\n")
    (tmp_path / "half_1.tsv").write_text("entity_id\tcountry\tbusiness_name\tbusiness_address\nS1-3\tFR\tCafe\t3 rue X\nS1-1\tUS\tother\tother\n")
    (tmp_path / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-9\t\nS1-8\tS2-2\n")
    assert sources.find_half(spark, str(tmp_path), 1).endswith("half_1.tsv") and sources.find_half(spark, str(tmp_path), 2) is None
    with pytest.raises(SystemExit) as stop:
        cli.main(["repair", str(tmp_path / "main1.tsv"), "--half-in", str(tmp_path), "--truth", str(tmp_path / "truth.tsv")])
    assert stop.value.code == 2 and last_line(capsys)["first"] == ["S1-8"]
    got = {tuple(r) for r in sources.read_source(spark, str(tmp_path / "main1.tsv")).collect()}
    assert got == {("S1-1", "Acme", "1 Main St, Springfield", "US"), ("S1-2", "Bolt", "2 Main St", "India")} | {("S1-3", "Cafe", "3 rue X", "FR")}
    assert (tmp_path / "main1.tsv.orig").is_file() and "Springfield" in (tmp_path / "main1.tsv.orig").read_text()


def test_exact_samples_and_small_functions(spark):
    frame = spark.range(100).selectExpr("CAST(id AS STRING) AS id")
    one = {r[0] for r in learning.sample_rows(frame, 17, "id").collect()}
    assert len(one) == 17 and one == {r[0] for r in learning.sample_rows(frame.repartition(7), 17, "id").collect()}
    assert learning.sample_rows(frame, 500, "id").count() == 100
    row = spark.createDataFrame([(" a\tb", 0.1234)], "line string, x double").select(text.first_field(F.col("line")), text.percent(F.col("x"))).first()
    assert tuple(row) == ("a", " 12.34%")


def test_third_model_and_its_gate(spark):
    rng = random.Random(2)
    rows, truth = [], []
    for i in range(160):
        for j in range(3):
            y = j == 0 and i % 2 == 0
            rows.append((f"S1-{i}", 2, f"S2-{i}-{j}", min(1.0, max(0.0, (0.6 if y else 0.35) + rng.uniform(-0.2, 0.2)))))
            if y:
                truth.append((f"S1-{i}", f"S2-{i}-{j}"))
    scored = spark.createDataFrame(rows, "s1_id string, src int, tgt_id string, p double")
    entities = spark.createDataFrame([(f"S1-{i}", "us" if i % 3 else None) for i in range(160)], "s1_id string, country string")
    known = spark.createDataFrame(truth, "s1_id string, tgt_id string")
    rules = [decide.Rule("threshold", t=t) for t in (0.3, 0.5, 0.7)]
    got = third.fit(scored, known, entities, rules=rules, trees=5, depth=2)
    assert 0 <= got.before <= 1 and 0 <= got.after <= 1 and got.accepted == (got.after - got.before >= 0.0005)
    assert third.rescore(got.model, third.features(scored, entities)).count() == 480


def test_learned_tables(spark):
    rows = [(1, f"S1-{i}", "Pirvate Kampani" if i % 2 else "Company House", "a", "in") for i in range(12)] + [(2, f"S2-{i}", "प्राइवेट कंपनी" if i % 2 else "Company Hse", "a", "in") for i in range(12)]
    frame = spark.createDataFrame(rows, "src int, entity_id string, business_name string, business_address string, country string")
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(12)], "s1_id string, tgt_id string")
    state = linkage.learn_state(frame, truth, linkage.Settings(mine_abbrev_min_count=3))
    assert state["translit"]["कंपनी"] == "kampani" and state["names"] == {"hse": "house"} and state["vocab"]["house"] == 6
    assert set(state) == {"translit", "protect", "vocab", "names", "addresses"}


def test_stream_is_cleaned_and_matched(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / f"in/{k}.tsv").write_text(f"src\tentity_id\tbusiness_name\tbusiness_address\tcountry\n2\tS2-{k}\tAcme Inc\t1 Main St\tus\n")
    cleaned = streaming.clean_stream(streaming.read_stream(spark, str(tmp_path / "in"), 1))
    query = streaming.match_stream(cleaned, lambda b: b.select("entity_id", "name_legal", F.col("addr_house")), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("entity_id", "name_legal", "addr_house").collect())
    assert got == [("S2-0", "incorporated", "1"), ("S2-1", "incorporated", "1")]
