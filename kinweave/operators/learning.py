"""Scoring pairs: gradient-boosted trees in two stages, isotonic calibration, and what is learned for cleaning."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.config import Settings
from kinweave.functions.text import is_abbreviation, key_similarity
from kinweave.operators.context import context_features

ENTITY_CONTEXT = ["ctx_rank_es", "ctx_gap_es", "ctx_n_es", "ctx_margin_es", "ctx_sum_e", "ctx_n_hi_e", "ctx_other_src_max"]
TARGET_CONTEXT = ["ctx_rank_rev", "ctx_gap_rev", "ctx_n_rev", "ctx_margin_rev"]


def sample_rows(df: DataFrame, n: int, column: str, seed: int = 42) -> DataFrame:
    """Exactly n rows of df, or all if there are fewer: those whose ids hash least, the same ones in any partitions."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(column).cast("string")).cast("binary")), column).limit(n)


def label_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with y: 1 if (s1_id, tgt_id) is true."""
    y = truth.select("s1_id", "tgt_id").distinct().withColumn("y", F.lit(1))
    return pairs.join(y, ["s1_id", "tgt_id"], "left").fillna(0, ["y"])


def fold(column: str, n: int, seed: int = 0):  # noqa: ANN201
    """A fold that depends on the id only, so all pairs of a record share it."""
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(n)).cast("int")


def hash_split(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """df with split: by crc32 of the id in thousandths."""
    bucket = F.crc32(F.col(column).cast("string").cast("binary")) % 1000
    out, top = F.lit(None).cast("string"), 1.0
    for name, share in reversed(shares.items()):
        out = F.when(bucket < round(top * 1000), F.lit(name)).otherwise(out)
        top -= share
    return df.withColumn("split", out)


def imputed(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Trees here refuse missing values: -1 for null, and a column that says so."""
    filled = {f"f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in features}
    missing = {f"m_{c}": F.col(c).isNull().cast("double") for c in features}
    return df.withColumns(filled | missing), [*filled, *missing]


def fit_trees(df: DataFrame, features: list[str], trees: int = 20, depth: int = 5, step: float = 0.1, min_rows: int = 1, row_share: float = 1.0, feature_share: float = 1.0, seed: int = 42) -> PipelineModel:
    ready, columns = imputed(df, features)
    boosted = GBTClassifier(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=step, minInstancesPerNode=min_rows, subsamplingRate=row_share, featureSubsetStrategy=str(feature_share) if feature_share < 1 else "all", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="x"), boosted]).fit(ready.withColumn("y", F.col("y").cast("double")))


def score_trees(model: PipelineModel, df: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    ready, columns = imputed(df, features)
    out = model.transform(ready).withColumn(name, vector_to_array("probability")[1])
    return out.drop(*columns, "x", "rawPrediction", "probability", "prediction")


def importance(model: PipelineModel, features: list[str]) -> dict[str, float]:
    values = model.stages[-1].featureImportances.toArray()
    n = len(features)
    return {c: float(values[i] + values[n + i]) for i, c in enumerate(features)}


def fit_two_stages(pairs: DataFrame, features: list[str], settings: Settings, reverse: bool = False) -> tuple[PipelineModel, PipelineModel, list[str]]:
    """Stage 1 on pair features; stage 2 adds context of out-of-fold stage-1 scores, folds by query record."""
    trees = settings.tree_options()
    marked = pairs.withColumn("fold", fold("s1_id", settings.n_folds, settings.seed))
    if settings.neg_keep < 1:
        keep = F.pmod(F.xxhash64("s1_id", "src", "tgt_id"), F.lit(10_000)) < settings.neg_keep * 10_000
        marked = marked.where((F.col("y") == 1) | keep)
    parts = [score_trees(fit_trees(marked.where(F.col("fold") != k), features, **trees), marked.where(F.col("fold") == k), features) for k in range(settings.n_folds)]
    held = parts[0]
    for p in parts[1:]:
        held = held.unionByName(p)
    more = features + ENTITY_CONTEXT + (TARGET_CONTEXT if reverse else [])
    second = fit_trees(context_features(held, reverse), more, **trees)
    return fit_trees(marked, features, **trees), second, more


def score_two_stages(first: PipelineModel, second: PipelineModel, pairs: DataFrame, features: list[str], more: list[str]) -> DataFrame:
    one = context_features(score_trees(first, pairs, features), any(c in more for c in TARGET_CONTEXT))
    return score_trees(second, one.withColumnRenamed("p", "p1"), more)


def fit_isotonic(scored: DataFrame) -> IsotonicRegressionModel:
    return IsotonicRegression(featuresCol="p", labelCol="y").fit(scored.select(F.col("p").cast("double"), F.col("y").cast("double")))


def calibrate(model: IsotonicRegressionModel, scored: DataFrame) -> DataFrame:
    out = model.transform(scored.withColumnRenamed("p", "raw_p").withColumn("p", F.col("raw_p").cast("double")))
    return out.withColumn("p", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))).drop("prediction", "raw_p")


# --- learned for cleaning ---


def vocabulary(words: DataFrame, least: int = 2, limit: int = 300_000) -> DataFrame:
    """words(word) -> the `limit` most frequent words of letters met `least` times or more."""
    counts = words.where(F.col("word").rlike("^[a-z]{2,}$")).groupBy("word").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)
    return counts.orderBy(F.desc("cnt"), "word").limit(limit)


def dictionary_votes(votes: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """votes(word, value) -> (word, value, cnt): each word's most frequent value, with support and a majority."""
    counts = votes.groupBy("word", "value").agg(F.count("*").alias("cnt"))
    own = Window.partitionBy("word")
    ranked = counts.withColumns({"total": F.sum("cnt").over(own), "rn": F.row_number().over(own.orderBy(F.desc("cnt"), "value"))})
    return ranked.where((F.col("rn") == 1) & (F.col("cnt") >= least) & (F.col("cnt") >= share * F.col("total"))).select("word", "value", "cnt")


def aligned_words(pairs: DataFrame, least: float = 0.45) -> DataFrame:
    """pairs(id, left, right) of word lists -> votes (word, value): by place if as long, else by closest sound key.

    left and right are arrays of (word, sound).
    """
    same = pairs.where(F.size("left") == F.size("right")).select(F.explode(F.arrays_zip("left", "right")).alias("z")).select(F.col("z.left.word").alias("word"), F.col("z.right.word").alias("value"))
    other = pairs.where(F.size("left") != F.size("right")).select("id", F.posexplode("left").alias("at", "l"), "right").select("id", "at", "l", F.explode("right").alias("r"))
    near = other.withColumn("sim", key_similarity(F.col("l.sound"), F.col("r.sound"))).groupBy("id", "at", F.col("l.word").alias("word"))
    best = near.agg(F.max_by(F.col("r.word"), F.struct("sim", F.col("r.word"))).alias("value"), F.max("sim").alias("sim")).where(F.col("sim") >= least)
    return same.unionByName(best.select("word", "value"))


def mine_abbreviations(pairs: DataFrame, protected: DataFrame, least: int = 25, share: float = 0.5, of_all: float = 0.2) -> DataFrame:
    """pairs(left, right) of true matches' words -> (short, long, cnt).

    A short form and a long one stand on opposite sides, each on its side only.  protected(word) are never short.
    """
    sides = pairs.select(F.array_distinct("left").alias("l"), F.array_distinct("right").alias("r"))
    seen = sides.select(F.explode(F.array_union("l", "r")).alias("short")).groupBy("short").agg(F.count("*").alias("seen"))
    alone = sides.select(F.array_except("l", "r").alias("a"), F.array_except("r", "l").alias("b"))
    met = alone.select("a", F.explode("b").alias("y")).select(F.explode("a").alias("x"), "y")
    both = met.select(F.col("x").alias("short"), F.col("y").alias("long")).unionByName(met.select(F.col("y").alias("short"), F.col("x").alias("long")))
    kept = both.where(is_abbreviation(F.col("short"), F.col("long"))).join(protected.select(F.col("word").alias("short")), "short", "left_anti")
    counts = kept.groupBy("short", "long").agg(F.count("*").alias("cnt"))
    own = Window.partitionBy("short")
    best = counts.withColumns({"total": F.sum("cnt").over(own), "rn": F.row_number().over(own.orderBy(F.desc("cnt"), "long"))}).where("rn = 1")
    best = best.where((F.col("cnt") >= least) & (F.col("cnt") >= share * F.col("total")))
    best = best.join(counts.select(F.col("short").alias("long")).distinct(), "long", "left_anti")
    return best.join(seen, "short").where(F.col("cnt") >= of_all * F.col("seen")).select("short", "long", "cnt")


def protected_words(pairs: DataFrame, least: int = 5) -> DataFrame:
    """pairs(word, kept, fixed): look-alikes of legal words that true matches keep as they are."""
    counts = pairs.groupBy("word").agg(F.sum(F.col("kept").cast("int")).alias("kept"), F.sum(F.col("fixed").cast("int")).alias("fixed"))
    return counts.where((F.col("kept") >= least) & (F.col("kept") >= F.col("fixed")))
