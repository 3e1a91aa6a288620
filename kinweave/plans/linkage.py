"""Training and prediction end to end, as one plan for each sink."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.config import Settings
from kinweave.functions import cleaning, indic, text
from kinweave.functions import tables as T
from kinweave.functions.cleaning import clean_records
from kinweave.operators import blocking, decide, learning
from kinweave.operators.features import FEATURES, pair_features
from kinweave.sources.shared import discard, materialise


@dataclass
class Model:
    first: PipelineModel
    second: PipelineModel
    isotonic: IsotonicRegressionModel
    rule: decide.Rule
    settings: Settings
    columns: list[str]
    state: dict = field(default_factory=dict)


def clean(records: DataFrame, state: dict | None = None) -> DataFrame:
    """Cleaned records, written once: candidates, statistics and features all read them, with the columns they need."""
    return materialise(clean_records(records, state))


#: Entries of a learned table at most; they are broadcast to the cleaning workers.
TABLE_ENTRIES = 300_000


def top(table: DataFrame, weight: str, key: str, n: int = TABLE_ENTRIES) -> DataFrame:
    """The n entries of most weight, by key among equals."""
    return table.orderBy(F.desc(weight), key).limit(n)


def _met(records: DataFrame, truth: DataFrame, fields: dict[str, str]) -> DataFrame:
    """True pairs with fields of both sides, as <name>_1 and <name>_2."""
    a = records.where("src = 1").select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"{n}_1") for n, c in fields.items()])
    b = records.where("src > 1").select(F.col("entity_id").alias("tgt_id"), *[F.col(c).alias(f"{n}_2") for n, c in fields.items()])
    return truth.join(a, "s1_id").join(b, "tgt_id")


def learn_translit(records: DataFrame, truth: DataFrame) -> dict[str, str]:
    """Words of Indian scripts with what true matches write for them, by votes."""
    pairs = _met(records, truth, {"raw": "business_name"}).where(text.has_indic(F.col("raw_2")) & ~text.has_indic(F.col("raw_1")))

    @F.pandas_udf("array<struct<word:string,sound:string>>")
    def sounds(names: pd.Series) -> pd.Series:
        def each(name: str) -> list[dict[str, str]]:
            words = indic.prepare(name or "").split() if indic.LETTERS.search(name or "") else cleaning.tokenize(cleaning.base_clean(name or ""))
            return [{"word": w, "sound": cleaning.phonetic(indic.to_latin(w))} for w in words]

        return names.map(each)

    ready = pairs.select(F.concat_ws(":", "s1_id", "tgt_id").alias("id"), sounds("raw_2").alias("left"), sounds("raw_1").alias("right"))
    votes = learning.aligned_words(ready).where(text.has_indic(F.col("word")))
    return {r["word"]: r["value"] for r in top(learning.dictionary_votes(votes), "cnt", "word").toLocalIterator()}


def learn_protected(records: DataFrame, truth: DataFrame) -> list[str]:
    """Look-alikes of legal words that are words of their own: true matches keep them."""
    words = _met(records, truth, {"raw": "business_name"}).select(*[text.tokens(text.base_clean(F.col(f"raw_{i}"))).alias(f"w{i}") for i in (1, 2)])

    @F.pandas_udf("string")
    def fixed(w: pd.Series) -> pd.Series:
        return w.map(cleaning.fix_legal_typo)

    each = words.select(F.explode(F.array_distinct("w1")).alias("word"), "w2").where(F.col("word").rlike("^[a-z]{5,}$") & ~text.one_of(T.LEGAL, F.col("word")))
    # The typo check runs once for each distinct word.
    known = each.select("word").distinct().withColumn("to", fixed("word")).where("to <> word")
    met = each.join(known, "word").select("word", F.array_contains("w2", F.col("word")).alias("kept"), (~F.array_contains("w2", F.col("word")) & F.array_contains("w2", F.col("to"))).alias("fixed"))
    return sorted(r["word"] for r in top(learning.protected_words(met), "kept", "word").toLocalIterator())


def learn_state(records: DataFrame, truth: DataFrame, settings: Settings | None = None) -> dict:
    """Learned tables for cleaning, each bounded: Indian words, protected words, vocabulary, short forms."""
    settings = settings or Settings()
    spark = records.sparkSession
    names = records.where(F.col("src") == 1).where(~text.has_indic(F.coalesce("business_name", F.lit(""))))
    words = names.select(F.explode(text.tokens(text.base_clean(F.col("business_name")))).alias("word"))
    state = {
        "translit": learn_translit(records, truth),
        "protect": learn_protected(records, truth),
        "vocab": {r["word"]: r["cnt"] for r in learning.vocabulary(words, limit=TABLE_ENTRIES).toLocalIterator()},
    }
    cleaned = clean_records(records, state)
    listed = {
        "names": ("name_tokens", T.NAME_SHORT.keys() | set(T.NAME_SHORT.values()) | T.LEGAL | T.NAME_STOP | T.HONORIFIC),
        "addresses": ("addr_tokens", T.ADDR_SHORT.keys() | set(T.ADDR_SHORT.values()) | T.ADDR_DROP | T.ADDR_STOP | T.STATE_CODES),
    }
    for name, (column, known) in listed.items():
        protected = spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in sorted(known)])).alias("word"))
        pairs = _met(cleaned, truth, {"w": column}).select(F.col("w_1").alias("left"), F.col("w_2").alias("right"))
        state[name] = {r["short"]: r["long"] for r in top(learning.mine_abbreviations(pairs, protected, settings.mine_abbrev_min_count), "cnt", "short").toLocalIterator()}
    return state


def candidates_and_features(cleaned: DataFrame, settings: Settings) -> DataFrame:
    return pair_features(materialise(blocking.generate_candidates(cleaned, settings)), cleaned)


def train(records: DataFrame, truth: DataFrame, settings: Settings | None = None, rules: list[decide.Rule] | None = None, state: dict | None = None) -> tuple[Model, DataFrame]:
    """(model, rule search): two-stage trees on most records, calibration and the rule on a held-out part, split by id.

    The number of records is kept with the model, so that block limits grow with larger corpora.
    """
    settings = settings or Settings()
    cleaned = clean(records, state)
    if not settings.ref_records:
        settings = replace(settings, ref_records=cleaned.count())
    shares = {"fit": 1 - settings.holdout_frac, "tune": settings.holdout_frac}
    split = materialise(learning.hash_split(learning.label_pairs(candidates_and_features(cleaned, settings), truth), "s1_id", shares))
    first, second, columns = learning.fit_two_stages(split.where("split = 'fit'"), FEATURES, settings)
    tune = learning.score_two_stages(first, second, split.where("split = 'tune'"), FEATURES, columns)
    isotonic = learning.fit_isotonic(tune)
    scored = learning.calibrate(isotonic, tune).select("s1_id", "src", "tgt_id", "p")
    entities = materialise(learning.hash_split(cleaned.where("src = 1").select(F.col("entity_id").alias("s1_id")), "s1_id", shares).where("split = 'tune'"))
    found = materialise(decide.search_rules(scored, truth.join(entities, "s1_id", "left_semi"), entities, rules))
    best = found.orderBy(F.desc("macro_f05"), "rule_id").first()
    for table in (split, cleaned):
        discard(table)
    return Model(first, second, isotonic, decide.rule_of(best), settings, columns, state or {}), found


def score_features(pairs: DataFrame, model: Model) -> DataFrame:
    """(s1_id, src, tgt_id, p) of pairs with their features."""
    scored = learning.score_two_stages(model.first, model.second, pairs, FEATURES, model.columns)
    return learning.calibrate(model.isotonic, scored).select("s1_id", "src", "tgt_id", "p")


def score(records: DataFrame, model: Model) -> DataFrame:
    """(s1_id, src, tgt_id, p) of all candidate pairs."""
    return score_features(candidates_and_features(clean(records, model.state), model.settings), model)


def blocking_tables(cleaned: DataFrame, truth: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """keys, usable keys, candidate pairs, and the true pairs missed with their cheap scores."""
    lands = cleaned.withColumn("country", F.col("country_norm"))
    keys = materialise(blocking.block_keys(lands, blocking.token_df(cleaned, "name_tokens"), blocking.token_df(cleaned, "addr_tokens"), settings.use_country_in_keys))
    usable = materialise(blocking.usable_keys(keys, settings, cleaned.count()))
    found = materialise(blocking.top_pairs(blocking.cheap_scores(blocking.candidate_pairs(keys, usable), cleaned, settings), settings))
    targets = cleaned.where("src > 1").select(F.col("entity_id").alias("tgt_id"), "src")
    missed = truth.distinct().join(found, ["s1_id", "tgt_id"], "left_anti").join(targets, "tgt_id")
    return {"keys": keys, "usable": usable, "pairs": found, "misses": materialise(blocking.cheap_scores(missed, cleaned, settings))}


def predict(records: DataFrame, model: Model) -> DataFrame:
    """All candidate pairs with p and keep."""
    return decide.decide(score(records, model), model.rule)


def consistent_sample(records: DataFrame, truth: DataFrame, share: float) -> DataFrame:
    """A share of the query records by id, all their matches, and the same share of the targets without a match."""
    draw = F.crc32(F.col("entity_id").cast("binary")) % 10_000 < round(share * 10_000)
    s1 = records.where((F.col("src") == 1) & draw)
    mine = truth.join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi").select(F.col("tgt_id").alias("entity_id")).distinct()
    targets = records.where("src > 1")
    orphans = targets.join(truth.select(F.col("tgt_id").alias("entity_id")), "entity_id", "left_anti").where(draw)
    return s1.unionByName(targets.join(mine, "entity_id", "left_semi")).unionByName(orphans)


def dev_set(records: DataFrame, truth: DataFrame, used: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """(records, truth) of query records not used(s1_id) for training; targets of used records go, all others stay."""
    free = truth.join(used, "s1_id", "left_anti")
    owned = truth.join(used, "s1_id", "left_semi").select(F.col("tgt_id").alias("entity_id"))
    draw = F.crc32(F.col("entity_id").cast("binary")) % 10_000 < round(share * 10_000)
    s1 = records.where((F.col("src") == 1) & draw).join(used.select(F.col("s1_id").alias("entity_id")), "entity_id", "left_anti")
    kept = s1.unionByName(records.where("src > 1").join(owned, "entity_id", "left_anti"))
    return kept, free.join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")


def has_shared_owner(truth: DataFrame) -> bool:
    """Whether a target belongs to more than one query record."""
    return not truth.distinct().groupBy("tgt_id").count().where("count > 1").isEmpty()


def true_pairs_side_by_side(truth: DataFrame, cleaned: DataFrame, fields: list[str], n: int) -> DataFrame:
    """The n true pairs that disagree most, both sides next to each other."""
    a = cleaned.where("src = 1").select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"{c}_1") for c in fields])
    b = cleaned.where("src > 1").select(F.col("entity_id").alias("tgt_id"), *[F.col(c).alias(f"{c}_2") for c in fields])
    unlike = sum(((F.col(f"{c}_1") != F.col(f"{c}_2")).cast("int") for c in fields), F.lit(0))
    return truth.join(a, "s1_id").join(b, "tgt_id").withColumn("n_disagree", unlike).orderBy(F.desc("n_disagree"), "s1_id", "tgt_id").limit(n)


