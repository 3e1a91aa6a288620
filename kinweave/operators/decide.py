"""Which pairs to keep: thresholds, expected F0.5, one owner for each target, and the metric itself."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.sources.shared import materialise


@dataclass(frozen=True)
class Rule:
    mode: str = "expected_f"
    t: float = 0.5
    miss: float = 0.0
    w0: float = 1.0
    min_p: float = 0.4
    single_owner: bool = False


def rule_of(row) -> Rule:  # noqa: ANN001
    """The rule of a row of search_rules()."""
    return Rule(**{k: row[k] for k in Rule.__dataclass_fields__})


# The parameters that are searched.
THRESHOLDS = (0.3, 0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.88, 0.9, 0.92, 0.94, 0.96, 0.98)
MISSES = (0.0, 0.05, 0.15, 0.3)
EMPTY_WEIGHTS = (0.8, 1.0, 1.2, 1.5, 2.0, 3.0)
LEAST_P = (0.05, 0.2, 0.4, 0.6)


def rule_grid() -> list[Rule]:
    """16 thresholds and 4 * 6 * 4 expected-F rules, each with and without one owner: 224 rules."""
    thresholds = [{"mode": "threshold", "t": t} for t in THRESHOLDS]
    expected = [{"miss": m, "w0": w, "min_p": p} for m, w, p in product(MISSES, EMPTY_WEIGHTS, LEAST_P)]
    return [Rule(**r, single_owner=s) for s in (False, True) for r in thresholds + expected]


def f05(tp: Column, kept: Column, true: Column) -> Column:
    """F0.5 of one record; with nothing kept and nothing true it is 1."""
    return F.when(kept + true == 0, F.lit(1.0)).otherwise(1.25 * tp / (kept + 0.25 * true))


def prefix_sums(scored: DataFrame) -> DataFrame:
    """scored with what all expected-F rules share: k, cum and sums by query record in order of p.  One shuffle."""
    p = F.least(F.greatest(F.col("p").cast("double"), F.lit(0.0)), F.lit(1.0))
    entity = Window.partitionBy("s1_id")
    order = entity.orderBy(F.desc("p"), "src", "tgt_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    none = F.log1p(-F.least(p, F.lit(1 - 1e-9)))
    return scored.withColumns({"q": p, "k": F.row_number().over(order), "cum": F.sum(p).over(upto), "all": F.sum(p).over(entity), "log_none": F.sum(none).over(entity)})


def expected_f_keep(ready: DataFrame, rule: Rule) -> DataFrame:
    """ready (from prefix_sums) with keep: the best prefix by expected F0.5, unless keeping nothing is expected to be better."""
    ef = F.when(F.col("q") >= rule.min_p, 1.25 * F.col("cum") / (F.col("k") + 0.25 * (F.col("all") + rule.miss))).otherwise(F.lit(-1.0))
    empty = rule.w0 * F.exp("log_none") * (1 - min(rule.miss, 0.99))
    best = F.max(F.struct(ef.alias("ef"), (-F.col("k")).alias("nk"))).over(Window.partitionBy("s1_id"))
    stop = F.when(empty >= best["ef"], F.lit(0)).otherwise(-best["nk"])
    return ready.withColumn("keep", F.col("k") <= stop)


def single_owner(decided: DataFrame) -> DataFrame:
    """Of the kept pairs of a target only the one with the highest p stays, the smallest s1_id of equals."""
    order = Window.partitionBy("src", "tgt_id", "keep").orderBy(F.desc("p"), "s1_id")
    return decided.withColumn("keep", F.col("keep") & (F.row_number().over(order) == 1))


def decide(scored: DataFrame, rule: Rule) -> DataFrame:
    """scored(s1_id, src, tgt_id, p, ...) with keep."""
    if rule.mode == "threshold":
        out = scored.withColumn("keep", F.col("p").cast("float") >= F.lit(rule.t).cast("float"))
    else:
        out = expected_f_keep(prefix_sums(scored), rule).drop("q", "k", "cum", "all", "log_none")
    return single_owner(out) if rule.single_owner else out


def entity_scores(decided: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """(s1_id, tp, kept, true, f05) for every row of entities(s1_id); truth(s1_id, tgt_id)."""
    y = truth.select("s1_id", "tgt_id").distinct().withColumn("y", F.lit(1))
    marked = decided.join(y, ["s1_id", "tgt_id"], "left")
    got = marked.groupBy("s1_id").agg(F.sum(F.when(F.col("keep") & (F.col("y") == 1), 1).otherwise(0)).alias("tp"), F.sum(F.col("keep").cast("int")).alias("kept"))
    want = y.groupBy("s1_id").agg(F.count("*").alias("true"))
    out = entities.select("s1_id").distinct().join(got, "s1_id", "left").join(want, "s1_id", "left").fillna(0, ["tp", "kept", "true"])
    return out.withColumn("f05", f05(F.col("tp"), F.col("kept"), F.col("true")))


def macro_f05(decided: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    return entity_scores(decided, truth, entities).agg(F.avg("f05").alias("macro_f05"), F.count("*").alias("n"))


#: Levels of a family of rules.
MOST_LEVELS = 6


def _families(rules: list[Rule]) -> tuple[dict[tuple, list[float]], list[tuple[int, int]]]:
    """Rules that share all but one number, in families of a few levels of it: thresholds, and the weights of nothing for each pair of
    miss and min_p; and the places of the rules in these: family and level."""
    kind = lambda r: (("t",), r.t) if r.mode == "threshold" else ((r.miss, r.min_p), r.w0)
    found: dict[tuple, set[float]] = {}
    for r in rules:
        found.setdefault(kind(r)[0], set()).add(kind(r)[1])
    out = {(*k, i): sorted(v)[i : i + MOST_LEVELS] for k, v in found.items() for i in range(0, len(v), MOST_LEVELS)}
    place = {(k[:-1], x): (i, j) for i, (k, own) in enumerate(out.items()) for j, x in enumerate(own)}
    return out, [place[kind(r)] for r in rules]


def _kept_levels(ready: DataFrame, families: dict[tuple, list[float]]) -> DataFrame:
    """ready (from prefix_sums) with upto_<i>: by how many levels of family i, the first ones, the pair is kept.

    What depends on the query record is one window column for each pair of miss and min_p.
    """
    entity = Window.partitionBy("s1_id")
    best = {}
    for f in families:
        if f[0] != "t":
            ef = F.when(F.col("q") >= f[1], 1.25 * F.col("cum") / (F.col("k") + 0.25 * (F.col("all") + f[0]))).otherwise(F.lit(-1.0))
            best[f[:2]] = F.max(F.struct(ef.alias("ef"), (-F.col("k")).alias("nk"))).over(entity)
    name = {f: f"best_{i}" for i, f in enumerate(best)}

    def keeps(f: tuple, level: float) -> Column:
        if f[0] == "t":
            return F.col("p").cast("float") >= F.lit(level).cast("float")
        b = F.col(name[f[:2]])
        return (F.col("k") <= -b["nk"]) & (level * F.exp("log_none") * (1 - min(f[0], 0.99)) < b["ef"])

    upto = [sum((F.when(keeps(f, x), 1).otherwise(0) for x in own), F.lit(0)).cast("tinyint").alias(f"upto_{i}") for i, (f, own) in enumerate(families.items())]
    return ready.withColumns({name[f]: c for f, c in best.items()}).select(*ready.columns, *upto)


def search_rules(scored: DataFrame, truth: DataFrame, entities: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(rule_id, mode, t, miss, w0, min_p, single_owner, macro_f05, precision, recall, empty): all rules in one job.

    empty: the share of records without a kept pair.  What a family's rules keep is nested by their levels, so a number tells it for
    a pair, and another one what the pairs before it at its target keep: one ranking tells a target's owner at every level.
    Pairs move as such numbers, a byte for each family; they are multiplied by families where their query record already is.
    """
    rules = rules or rule_grid()
    spark = scored.sparkSession
    families, place = _families(rules)
    y = truth.select("s1_id", "tgt_id").distinct().withColumn("y", F.lit(1))
    marked = prefix_sums(scored).join(y, ["s1_id", "tgt_id"], "left").withColumn("y", F.coalesce("y", F.lit(0)).cast("tinyint"))
    kept = _kept_levels(marked, families)
    # A pair owns its target at the levels at which no pair before it is kept.
    before = Window.partitionBy("src", "tgt_id").orderBy(F.desc("p"), "s1_id").rowsBetween(Window.unboundedPreceding, -1)
    each = range(len(families))
    kept = kept.withColumns({f"before_{i}": F.coalesce(F.max(f"upto_{i}").over(before), F.lit(0).cast("tinyint")) for i in each})
    kept = kept.select("s1_id", "y", *[f"{c}_{i}" for i in each for c in ("upto", "before")]).repartition("s1_id")
    cells = F.array(*[F.struct(F.lit(i).alias("family"), F.col(f"upto_{i}").alias("upto"), F.col(f"before_{i}").alias("before")) for i in each])
    rows = kept.select("s1_id", "y", F.explode(F.filter(cells, lambda x: x["upto"] > 0)).alias("x")).select("s1_id", "y", "x.*")
    at = lambda j, owner: (F.col("upto") > j) & (F.col("before") <= j) if owner else F.col("upto") > j
    sums = [F.struct(F.lit(j).alias("level"), F.lit(o).alias("owner"), F.sum(F.when(at(j, o), F.col("y")).otherwise(0)).alias("tp"), F.sum(at(j, o).cast("int")).alias("kept")) for j in range(max(map(len, families.values()))) for o in (False, True)]
    got = rows.groupBy("s1_id", "family").agg(F.array(*sums).alias("x"))
    ids = entities.select("s1_id").distinct()
    want = ids.join(y.groupBy("s1_id").agg(F.count("*").alias("true")), "s1_id", "left").fillna(0, ["true"])
    # Records without a kept pair score 1 if they have no match and 0 otherwise: count them from totals.
    each_kept = got.join(want, "s1_id").select("family", "true", F.explode("x").alias("x")).select("family", "true", "x.*").where("kept > 0")
    met = each_kept.groupBy("family", "level", "owner").agg(
        F.sum(f05(F.col("tp"), F.col("kept"), F.col("true"))).alias("sum"), F.count(F.when(F.col("true") == 0, 1)).alias("empty_kept"), F.sum("tp").alias("tp"), F.sum("kept").alias("kept"), F.count("*").alias("some")
    )
    total = want.agg(F.count("*").alias("n"), F.count(F.when(F.col("true") == 0, 1)).alias("empty"), F.coalesce(F.sum("true"), F.lit(0)).alias("true")).first()
    cells = [F.struct(F.lit(i).alias("rule_id"), *[F.lit(v).alias(k) for k, v in vars(r).items()], *[F.lit(v).alias(k) for k, v in zip(("family", "level", "owner"), (*at_, r.single_owner))]) for i, (r, at_) in enumerate(zip(rules, place))]
    table = spark.range(1).select(F.explode(F.array(*cells)).alias("r")).select("r.*")
    out = table.join(met, ["family", "level", "owner"], "left").fillna(0, ["sum", "empty_kept", "tp", "kept", "some"])
    scores = {
        "macro_f05": (F.col("sum") + total["empty"] - F.col("empty_kept")) / total["n"],
        "precision": F.col("tp") / F.greatest(F.col("kept"), F.lit(1)),
        "recall": F.col("tp") / max(total["true"], 1),
        "empty": 1 - F.col("some") / total["n"],
    }
    return out.select("rule_id", *Rule.__dataclass_fields__, *[v.alias(k) for k, v in scores.items()])


def tuned(scored: DataFrame, truth: DataFrame, entities: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """search_rules() with best, the first rule of the highest macro_f05 to six places, and again: its macro_f05, decided the plain way."""
    found = materialise(search_rules(scored, truth, entities, rules))
    first = found.orderBy(F.desc(F.round("macro_f05", 6)), "rule_id").first()
    again = macro_f05(decide(scored, rule_of(first)), truth, entities).first()["macro_f05"]
    best = F.col("rule_id") == first["rule_id"]
    return found.withColumns({"best": best, "again": F.when(best, F.lit(again).cast("double"))})
