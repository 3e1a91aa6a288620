"""Command line: python -m kinweave.cli COMMAND --help."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinweave.config import Settings
from kinweave.functions import text
from kinweave.operators import blocking, decide, report
from kinweave.plans import linkage, runner, store, third
from kinweave.sources import records as files
from kinweave.sources.shared import materialise


def _records(spark: SparkSession, a: argparse.Namespace):  # noqa: ANN202
    return files.read_sources(spark, {1: a.s1, 2: a.s2, 3: a.s3})


def repair(spark: SparkSession, a: argparse.Namespace) -> None:
    """Main files, then the half file of their folder; with --truth, ids that no record has make the command fail."""
    paths = list(a.paths)
    half = files.find_half(spark, a.half_in, a.source) if a.half_in else None
    # Written first, as the files that it is read from may be replaced.
    one = materialise(files.first_by_id(*[files.repair_file(spark, p, a.source) for p in [*paths, *([half] if half else [])]]))
    print(json.dumps(files.repair_report(one, a.source).first().asDict()))
    if a.out:
        files.write_table(one.select(*files.COLUMNS), a.out)
    else:
        print(json.dumps({"kept": files.replace_file(spark, one.select(*files.COLUMNS), paths[0])}))
    if a.truth:
        broken = files.missing_ids(files.read_truth(spark, a.truth)[0], one)
        broken = broken.where(F.col("entity_id").startswith(f"S{a.source}-"))
        n = broken.count()
        print(json.dumps({"missing": n, "first": sorted(r[0] for r in broken.orderBy("entity_id").limit(20).collect())}))
        if n:
            raise SystemExit(2)


def fit_cleaning(spark: SparkSession, a: argparse.Namespace) -> None:
    state = linkage.learn_state(_records(spark, a), files.read_truth(spark, a.truth)[0], Settings(**json.loads(a.settings)))
    store.save_state(spark, state, a.out)
    print(json.dumps({k: len(v) for k, v in state.items()}))


def clean(spark: SparkSession, a: argparse.Namespace) -> None:
    """Cleaned records, from the cache if they are there; --preview: the first records of each source as a table."""
    signature = json.dumps([a.s1, a.s2, a.s3])
    cleaned = store.cleaned(spark, _records(spark, a), store.load_state(spark, a.state) if a.state else {}, a.out, signature)
    print(json.dumps({"rows": cleaned.count()}))
    if a.preview:
        files.write_table(report.stratified(cleaned, "src", a.preview, "entity_id"), f"{a.out}/preview")


def pairs(spark: SparkSession, a: argparse.Namespace) -> None:
    """True pairs side by side, those that disagree most first."""
    cleaned = linkage.clean(_records(spark, a), store.load_state(spark, a.state) if a.state else {})
    fields = ["name_core", "name_legal", "addr_house", "addr_street", "addr_postal", "addr_state", "country_norm"]
    files.write_table(linkage.true_pairs_side_by_side(files.read_truth(spark, a.truth)[0], cleaned, fields, a.n), a.out)


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    recs, (truth, _) = _records(spark, a), files.read_truth(spark, a.truth)
    settings = Settings(**json.loads(a.settings))
    if a.share < 1:
        recs = linkage.consistent_sample(recs, truth, a.share)
        truth = truth.join(recs.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
    model, found = linkage.train(recs, truth, settings, state=linkage.learn_state(recs, truth, settings))
    store.save(spark, model, a.out)
    found.orderBy(F.desc("macro_f05")).show(10, truncate=False)


def predict(spark: SparkSession, a: argparse.Namespace) -> None:
    """Id lists in the order of the first source, by the model's rule or, with --third, the third model's."""
    recs, model = _records(spark, a), store.load(spark, a.model)
    if a.from_scores:
        scored = spark.read.parquet(a.from_scores)
    else:
        scored = runner.run(spark, [("scores", lambda _: linkage.score(recs, model))], a.out, resume=a.resume)["scores"]
    s1 = recs.where("src = 1").select(F.col("entity_id").alias("s1_id"), "country")
    decided = third.apply(third.load(spark, a.third), scored, s1) if a.third else decide.decide(scored, model.rule)
    kept = decided.where("keep")
    matches, candidates = files.id_lists(s1, kept, in_order=True), files.id_lists(s1, scored, "candidate_entity_ids", in_order=True)
    files.write_table(matches, f"{a.out}/matching_results")
    files.write_table(candidates, f"{a.out}/candidate_pairs")
    files.empty_share(matches, recs).orderBy("country").withColumn("empty", text.percent(F.col("empty"))).show(100, truncate=False)
    if a.zip:
        files.pack(spark, {n: f"{a.out}/{n}" for n in ("matching_results", "candidate_pairs")}, a.zip)
    print(json.dumps(files.validate(matches, s1, recs.where("src > 1"), scored)))


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    """Cleaning, training and prediction in one go, each step resumed where it stopped."""
    recs, (truth, _), settings = _records(spark, a), files.read_truth(spark, a.truth), Settings(**json.loads(a.settings))
    files_of = {k: f"{a.out}/{k}" for k in ("state", "model", "result")}
    began = time.time()
    if not (a.resume and files.exists(spark, f"{files_of['model']}/manifest/_SUCCESS")):
        if not (a.resume and files.exists(spark, f"{files_of['state']}/_SUCCESS")):
            store.save_state(spark, linkage.learn_state(recs, truth, settings), files_of["state"])
            runner.log(spark, "state: done", began)
        model, found = linkage.train(recs, truth, settings, state=store.load_state(spark, files_of["state"]))
        store.save(spark, model, files_of["model"])
        runner.log(spark, f"model: done, F0.5 {found.agg(F.max('macro_f05')).first()[0]:.4f}", began)
    model = store.load(spark, files_of["model"])
    steps = [
        ("cleaned", lambda _: linkage.clean_records(recs, model.state)),
        ("candidates", lambda t: blocking.generate_candidates(t["cleaned"], model.settings)),
        ("features", lambda t: linkage.pair_features(t["candidates"], t["cleaned"])),
        ("scores", lambda t: linkage.score_features(t["features"], model)),
        ("decided", lambda t: decide.decide(t["scores"], model.rule)),
    ]
    left = a.deadline - (time.time() - began) if a.deadline else None
    made = runner.run(spark, steps, files_of["result"], a.resume, deadline=left)
    s1 = recs.where("src = 1").select(F.col("entity_id").alias("s1_id"))
    lists = files.id_lists(s1, made["decided"].where("keep"), in_order=True)
    lists.write.mode("overwrite").parquet(f"{files_of['result']}/lists")
    print(json.dumps(files.validate(spark.read.parquet(f"{files_of['result']}/lists"), s1, recs.where("src > 1"), made["scores"])))


def devset(spark: SparkSession, a: argparse.Namespace) -> None:
    recs, (truth, _) = _records(spark, a), files.read_truth(spark, a.truth)
    dev, answers = linkage.dev_set(recs, truth, spark.read.text(a.used).select(text.first_field(F.col("value")).alias("s1_id")), a.share)
    for k in (1, 2, 3):
        files.write_table(dev.where(F.col("src") == k).select(*files.COLUMNS), f"{a.out}/dev_source{k}")
    files.write_table(files.id_lists(dev.where("src = 1").select(F.col("entity_id").alias("s1_id")), answers), f"{a.out}/dev_ground_truth")


def tune(spark: SparkSession, a: argparse.Namespace) -> None:
    """All rules; the best is decided once more the plain way, and written only if it scores the same and better than the model's."""
    (truth, entities), scored = files.read_truth(spark, a.truth), spark.read.parquet(a.scores)
    found = decide.search_rules(scored, truth, entities).orderBy(F.desc("macro_f05"), "rule_id")
    found.show(20, truncate=False)
    best = found.first()
    rule = decide.rule_of(best)
    again = decide.macro_f05(decide.decide(scored, rule), truth, entities).first()["macro_f05"]
    same = abs(again - best["macro_f05"]) < 1e-4
    out = {"best": best["macro_f05"], "again": again, "same": same, "written": False}
    if a.write and same:
        model = store.load(spark, a.write)
        out["current"] = decide.macro_f05(decide.decide(scored, model.rule), truth, entities).first()["macro_f05"]
        if again >= out["current"]:
            model.rule = rule
            store.save_rule(spark, model, a.write)
            out["written"] = True
    print(json.dumps(out))


def stage3(spark: SparkSession, a: argparse.Namespace) -> None:
    truth, entities = files.read_truth(spark, a.truth)
    lands = files.read_source(spark, a.s1).select(F.col("entity_id").alias("s1_id"), "country")
    got = third.fit(spark.read.parquet(a.scores), truth, entities.join(lands, "s1_id", "left"), a.min_gain, **json.loads(a.trees))
    print(json.dumps({"before": got.before, "after": got.after, "accepted": got.accepted, "rule": vars(got.rule)}))
    if got.accepted:
        third.save(spark, got, a.out)


def check_blocking(spark: SparkSession, a: argparse.Namespace) -> None:
    """Cost, recall, use of keys, the bound of a perfect matcher, why matches are missed; examples go to --out."""
    recs, (truth, _), settings = _records(spark, a), files.read_truth(spark, a.truth), Settings(**json.loads(a.settings))
    cleaned = linkage.clean(recs)
    made = linkage.blocking_tables(cleaned, truth, settings)
    parts = report.blocking_report(truth, made["pairs"], cleaned, made["misses"], made["keys"], made["usable"], a.examples)
    for name, table in parts.items():
        if name != "examples":
            print(f"== {name}")
            shares = [c for c in ("recall", "share") if c in table.columns]
            table.withColumns({c: text.percent(F.col(c)) for c in shares}).show(100, truncate=False)
    report.upper_bound(made["pairs"], truth, cleaned.where("src = 1").select(F.col("entity_id").alias("s1_id"))).show()
    if a.out:
        files.write_table(parts["examples"], a.out)


def loss(spark: SparkSession, a: argparse.Namespace) -> None:
    truth, _ = files.read_truth(spark, a.truth)
    lands = files.read_source(spark, a.s1).select(F.col("entity_id").alias("s1_id"), "country")
    decided = decide.decide(spark.read.parquet(a.scores), store.load(spark, a.model).rule)
    buckets = report.loss_buckets(decided, truth, lands)
    report.loss_table(buckets).orderBy(F.col("country").asc_nulls_last()).show(100, truncate=False)
    if a.out:
        files.write_table(report.error_rows(decided, truth, buckets, _records(spark, a), a.examples), a.out)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="kinweave")
    sub = top.add_subparsers(required=True)

    def command(f, *names: str, **defaults) -> argparse.ArgumentParser:  # noqa: ANN001
        p = sub.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        p.set_defaults(f=f)
        for n in names:
            p.add_argument(f"--{n}", required=True)
        for n, v in defaults.items():
            p.add_argument(f"--{n.replace('_', '-')}", default=v, type=type(v) if v is not None else str)
        return p

    sources = ("s1", "s2", "s3")
    command(repair, source=1, out=None, half_in=None, truth=None).add_argument("paths", nargs="+")
    command(fit_cleaning, *sources, "truth", "out", settings="{}")
    command(clean, *sources, "out", state=None, preview=0)
    command(pairs, *sources, "truth", "out", state=None, n=200)
    command(train, *sources, "truth", "out", share=1.0, settings="{}")
    command(predict, *sources, "model", "out", from_scores=None, third=None, zip=None).add_argument("--resume", action="store_true")
    command(run, *sources, "truth", "out", settings="{}", deadline=0.0).add_argument("--resume", action="store_true")
    command(devset, *sources, "truth", "used", "out", share=0.1)
    command(tune, "scores", "truth", write=None)
    command(stage3, "scores", "truth", "s1", "out", min_gain=0.0005, trees="{}")
    command(check_blocking, *sources, "truth", settings="{}", examples=20, out=None)
    command(loss, *sources, "scores", "truth", "model", examples=10, out=None)
    a = top.parse_args(argv)
    a.f(SparkSession.builder.appName("kinweave").getOrCreate(), a)


if __name__ == "__main__":
    main()
