"""A trained model on disk: Spark's own model folders and one manifest."""

from __future__ import annotations

import hashlib
import json

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession

from kinweave.config import Settings
from kinweave.operators.decide import Rule
from kinweave.plans import linkage
from kinweave.plans.linkage import Model
from kinweave.sources.records import exists


def save(spark: SparkSession, model: Model, path: str) -> None:
    """Everything that prediction needs under path, which must be new or is overwritten as a whole."""
    for name, part in (("first", model.first), ("second", model.second), ("isotonic", model.isotonic)):
        part.write().overwrite().save(f"{path}/{name}")
    save_rule(spark, model, path)


def save_rule(spark: SparkSession, model: Model, path: str) -> None:
    """The manifest alone: rule, settings, columns and learned tables of a model that is on disk."""
    manifest = json.dumps({"rule": vars(model.rule), "settings": model.settings.to_dict(), "columns": model.columns, "state": model.state}, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> Model:
    m = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest").collect()))
    return Model(PipelineModel.load(f"{path}/first"), PipelineModel.load(f"{path}/second"), IsotonicRegressionModel.load(f"{path}/isotonic"), Rule(**m["rule"]), Settings(**m["settings"]), m["columns"], m["state"])


def save_state(spark: SparkSession, state: dict, path: str) -> None:
    """The learned tables of cleaning, as one JSON line."""
    spark.createDataFrame([(json.dumps(state, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_state(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def cleaned(spark: SparkSession, records: DataFrame, state: dict, folder: str, signature: str) -> DataFrame:
    """Cleaned records from a cache by learned state and the records' signature, written by source and country if they are not there."""
    mark = hashlib.md5(json.dumps([state, signature], ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    path = f"{folder.rstrip('/')}/cleaned-{mark}"
    if not exists(spark, f"{path}/_SUCCESS"):
        out = linkage.clean_records(records, state)
        out.withColumn("part_src", out["src"]).withColumn("part_country", out["country_norm"]).write.mode("overwrite").partitionBy("part_src", "part_country").parquet(path)
    return spark.read.parquet(path).drop("part_src", "part_country")
