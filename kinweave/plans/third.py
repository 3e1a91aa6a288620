"""A third model on development scores: context of final scores, early stopping, and a gate on its gain."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import context, decide, learning

FEATURES = [*learning.ENTITY_CONTEXT, *learning.TARGET_CONTEXT, "p", "logit_p"]


@dataclass
class Third:
    model: PipelineModel
    rule: decide.Rule
    before: float
    after: float
    accepted: bool


def features(scored: DataFrame, entities: DataFrame) -> DataFrame:
    """scored(s1_id, src, tgt_id, p) with the 13 features, context within the query record's country (? if unknown)."""
    land = entities.select("s1_id", "country").dropDuplicates(["s1_id"])
    met = scored.join(land, "s1_id", "left").withColumn("country", F.coalesce("country", F.lit("?")))
    return context.with_logit(context.context_features(met, True, ["country"]))


def rescore(model: PipelineModel, ready: DataFrame) -> DataFrame:
    return learning.score_trees(model, ready.withColumnRenamed("p", "old_p").withColumn("p", F.col("old_p")), FEATURES, "new_p").select("s1_id", "src", "tgt_id", F.col("new_p").alias("p"))


def fit(scored: DataFrame, truth: DataFrame, entities: DataFrame, least_gain: float = 0.0005, rules: list[decide.Rule] | None = None, trees: int = 40, depth: int = 4, seed: int = 42) -> Third:
    """Half of the query records fit the model, a quarter stops it and chooses the rule, a quarter checks the gain."""
    shares = {"fit": 0.5, "tune": 0.25, "check": 0.25}
    ready = learning.hash_split(learning.label_pairs(features(scored, entities), truth), "s1_id", shares).persist()
    split = learning.hash_split(entities, "s1_id", shares)
    filled, columns = learning.imputed(ready.where("split <> 'check'").withColumn("stop", F.col("split") == "tune").withColumn("y", F.col("y").cast("double")), FEATURES)
    stages = [VectorAssembler(inputCols=columns, outputCol="x"), GBTClassifier(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.08, validationIndicatorCol="stop", seed=seed)]
    model = Pipeline(stages=stages).fit(filled)

    def best(rows: DataFrame, part: str, only: list[decide.Rule] | None) -> tuple[decide.Rule, float]:
        ids = split.where(F.col("split") == part)
        own = truth.join(ids, "s1_id", "left_semi")
        r = decide.search_rules(rows.join(ids.select("s1_id"), "s1_id", "left_semi"), own, ids, only).orderBy(F.desc("macro_f05"), "rule_id").first()
        return decide.rule_of(r), r["macro_f05"]

    new = rescore(model, ready)
    old_rule, _ = best(scored, "tune", rules)
    rule, _ = best(new, "tune", rules)
    before, after = best(scored, "check", [old_rule])[1], best(new, "check", [rule])[1]
    ready.unpersist()
    return Third(model, rule, before, after, after - before >= least_gain)


def save(spark: SparkSession, got: Third, path: str) -> None:
    got.model.write().overwrite().save(f"{path}/model")
    line = json.dumps({"rule": vars(got.rule), "before": got.before, "after": got.after})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> Third:
    m = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return Third(PipelineModel.load(f"{path}/model"), decide.Rule(**m["rule"]), m["before"], m["after"], True)


def apply(got: Third, scored: DataFrame, entities: DataFrame) -> DataFrame:
    """All pairs of scored(s1_id, src, tgt_id, p) with the third model's p, and keep by its rule; entities(s1_id, country)."""
    return decide.decide(rescore(got.model, features(scored, entities)), got.rule)
