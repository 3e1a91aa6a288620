"""The corpus pipeline: stages over documents, each reading what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import contamination, languages, mixing, pii, simhash
from kinweave.llm.common import discard, materialise, sweep, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text, no letter) go; the others get the predicted one as lang.

    Rows with null lang are predicted like others.  Without any labelled row no language can be told: no document stays.
    Repeated rows are told alike; columns that clash with the operator's are kept as they are; an empty table stays empty.
    """
    found = languages.identify(docs, languages.fit_sample(docs))
    return found.where(F.col("lang_pred") != languages.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


#: Ids of dropped documents that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: the one with the smallest doc_id, null being the largest, then the least text.

    Rows of one doc_id, or without any, whose texts are no near copies all stay.  The ids that go are far fewer than
    those that stay, and the texts need no shuffle to meet them.  Null, empty and blank texts are near copies of one another;
    other columns keep their values; an empty table stays empty.
    """
    groups = materialise(simhash.near_roots(docs))
    small = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    gone = materialise(groups.where("doc_id <> component_id").select("doc_id").distinct())
    unclear = materialise(groups.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__id")))
    if unclear.isEmpty():
        return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    # An id that is null or met twice does not tell which row is meant: these rows are told apart by their fingerprints.
    same = docs["doc_id"].eqNullSafe(unclear["__id"])
    clear = docs.join(small(unclear), same, "left_anti").join(small(gone), "doc_id", "left_anti")
    rows = materialise(docs.join(small(unclear), same, "left_semi").withColumn("__row", F.monotonically_increasing_id()))
    prints = simhash.fingerprints(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "fp")
    first = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias("__id"), "fp", "root").distinct()
    placed = rows.join(prints, "__row").join(first, "fp").where("doc_id <=> __id")
    stays = placed.groupBy("root").agg(F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")], "__row")).alias("least"))
    chosen = rows.join(stays.select(F.col("least.__row").alias("__row")), "__row", "left_semi")
    return clear.select(*docs.columns).unionByName(chosen.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go.

    Null or empty text has no window and stays.  Items without words, and an empty benchmark, are in no document.
    Repeated rows stay or go together, each row by its own text; columns keep their values; an empty table stays empty.
    """
    found = contamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.where("leak.n_hit = 0").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows the text.

    No row goes.  Null text stays null, and its n_chars becomes null; rows of one doc_id are changed each by its own text;
    other columns keep their values, whatever their names; an empty table stays empty.
    """
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each time that a document is drawn, with its epoch, block and place.

    Null source is a source of its own.  A source without any token has no weight and is left out; every other one has
    rows.  Repeated rows of a doc_id are drawn together; columns named epoch, block or place are replaced; an empty table
    gives an empty result.
    """
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact", redact),
    ("mix", mix),
]

#: A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each over what the one before it wrote; what a stage wrote on its way goes when it is done."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        mark = written()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
            sweep(mark, keep=docs)
            if before is not None:
                discard(before)
            before = docs
    return docs
