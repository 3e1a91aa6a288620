"""Named queries over the driver's tables, one or more for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.config import Settings
from kinweave.functions import similarity, text
from kinweave.operators import blocking, context, decide, features, learning, report
from kinweave.plans import fixture
from kinweave.plans.fixture import table
from kinweave.sources import records as sources
from kinweave.sources.shared import discard, materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: As in production.
SETTINGS = Settings()

# --- the fixture in SQL; each block builds on those before it ---

WORDS = "list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
SQL_RECORDS = f"""
WITH base AS (SELECT 1 + doc_id % 3 AS src, 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, coalesce(lang, '') AS country, {WORDS} AS k FROM documents),
rec AS (SELECT src, entity_id, country, k[1:6] AS nt, k[7:] AS adt, array_to_string(k, ' ') AS f FROM base)
"""
SQL_STATS = SQL_RECORDS + """,
name_df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(nt)) AS token FROM rec) GROUP BY token),
addr_df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(adt)) AS token FROM rec) GROUP BY token)
"""
SQL_KEYS = SQL_STATS + """,
nr AS (SELECT src, entity_id, list(token ORDER BY df, token) AS r FROM (SELECT src, entity_id, unnest(list_distinct(nt)) AS token FROM rec) JOIN name_df USING (token) WHERE length(token) >= 2 GROUP BY ALL),
ar AS (SELECT src, entity_id, list(token ORDER BY df, token) AS r FROM (SELECT src, entity_id, unnest(list_distinct(adt)) AS token FROM rec) JOIN addr_df USING (token) WHERE NOT regexp_matches(token, '[0-9]') GROUP BY ALL),
skel AS (SELECT src, entity_id, r, string_split(r[1][1] || regexp_replace(r[1][2:], '[aeiouhwy0-9]', '', 'g'), '') AS c FROM nr),
rr AS (
  SELECT rec.src, rec.entity_id, country, nr.r AS n, ar.r AS a, array_to_string(nt, '') AS compact, array_to_string(list_sort(nt), ' ') AS nkey,
    array_to_string(list_transform(nt, lambda w: w[1]), '') AS ini, coalesce(list_filter(adt, lambda w: regexp_matches(w, '[0-9]'))[1], '') AS house,
    array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: i = 1 OR c[i] <> c[i - 1]), lambda i: c[i]), '')[1:5] AS sk
  FROM rec LEFT JOIN nr ON nr.src = rec.src AND nr.entity_id = rec.entity_id LEFT JOIN ar ON ar.src = rec.src AND ar.entity_id = rec.entity_id
    LEFT JOIN skel ON skel.src = rec.src AND skel.entity_id = rec.entity_id),
long AS (
  SELECT *, unnest([
    {'kt': 0, 'name': 'n1', 'v': n[1]},
    {'kt': 1, 'name': 'nn', 'v': CASE WHEN len(n) >= 2 THEN array_to_string(list_sort(n[1:2]), '|') END},
    {'kt': 2, 'name': 'nc', 'v': nullif(compact, '')},
    {'kt': 3, 'name': 'nf', 'v': CASE WHEN n[1] IS NOT NULL THEN sk || coalesce('|' || n[2][1], '') END},
    {'kt': 4, 'name': 'a2', 'v': CASE WHEN len(a) >= 2 THEN array_to_string(list_sort(a[1:2]), '|') END},
    {'kt': 5, 'name': 'hs', 'v': nullif(house, '') || '|' || a[1]},
    {'kt': 6, 'name': 'na', 'v': n[1] || '|' || a[1]},
    {'kt': 7, 'name': 'ia', 'v': CASE WHEN length(ini) >= 2 THEN ini || '|' || a[1] END},
    {'kt': 8, 'name': 'np', 'v': CASE WHEN length(compact) >= 5 THEN compact[1:5] || '|' || a[1] END},
    {'kt': 9, 'name': 'nk', 'v': CASE WHEN contains(nkey, ' ') THEN nkey END}]) AS x FROM rr),
keys AS (SELECT DISTINCT src, entity_id, country, x.kt AS kt, x.name || '|' || country || '|' || x.v AS key FROM long WHERE x.v IS NOT NULL)
"""
SQL_USABLE = SQL_KEYS + f""",
sizes AS (SELECT key, kt, s AS tgt_src, count(*) FILTER (src = 1) AS a, count(*) FILTER (src = s) AS b FROM keys, (VALUES (2), (3)) t(s) GROUP BY ALL),
usable AS (SELECT * FROM sizes WHERE a > 0 AND b > 0 AND b <= {SETTINGS.max_block_target} AND a * b <= {SETTINGS.max_block_pairs})
"""
SQL_PAIRS = SQL_USABLE + """,
pairs AS (
  SELECT l.entity_id AS s1_id, r.src, r.entity_id AS tgt_id, r.country, bit_or(1::BIGINT << r.kt) AS key_mask, count(*) AS n_keys
  FROM keys l JOIN keys r ON l.key = r.key AND l.src = 1 AND r.src > 1 JOIN usable u ON u.key = r.key AND u.tgt_src = r.src GROUP BY ALL)
"""
#: A score for pairs that SQL can state too: Jaccard of name and of address tokens.
SQL_SCORED = SQL_PAIRS + f""",
scored AS (
  SELECT p.*, coalesce(len(list_intersect(a.nt, b.nt)) / nullif(len(list_distinct(list_concat(a.nt, b.nt))), 0), 0) AS cos_name,
    coalesce(len(list_intersect(a.adt, b.adt)) / nullif(len(list_distinct(list_concat(a.adt, b.adt))), 0), 0) AS cos_addr
  FROM pairs p JOIN rec a ON a.entity_id = p.s1_id JOIN rec b ON b.entity_id = p.tgt_id),
cheap AS (SELECT *, round({SETTINGS.name_weight} * cos_name + {1 - SETTINGS.name_weight} * cos_addr, 6) AS cheap FROM scored)
"""
SQL_TOP = SQL_SCORED + f""",
r3 AS (SELECT *, row_number() OVER (PARTITION BY s1_id, src ORDER BY cheap DESC, tgt_id) AS r1, row_number() OVER (PARTITION BY s1_id, src ORDER BY cos_name DESC, tgt_id) AS r2,
  row_number() OVER (PARTITION BY s1_id, src ORDER BY cos_addr DESC, tgt_id) AS r3 FROM cheap),
topk AS (SELECT *, row_number() OVER (PARTITION BY s1_id, src ORDER BY cheap DESC, tgt_id) AS rank_cheap FROM r3
  WHERE (r1 <= {SETTINGS.topk_joint} OR r2 <= {SETTINGS.topk_name} OR r3 <= {SETTINGS.topk_addr}) AND cheap >= {SETTINGS.min_cheap}),
p AS (SELECT s1_id, src, tgt_id, country, key_mask, cheap AS p FROM topk),
truth AS (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS tgt_id FROM rec a JOIN rec b ON a.country = b.country AND a.f = b.f AND a.src = 1 AND b.src > 1),
ents AS (SELECT entity_id AS s1_id, country FROM rec WHERE src = 1)
"""
RULE = decide.Rule(miss=0.05, w0=1.0, min_p=0.2, single_owner=True)
SQL_RULE = SQL_TOP + f""",
pre AS (SELECT *, least(greatest(p, 0), 1) AS q FROM p),
sums AS (SELECT *, row_number() OVER o AS k, sum(q) OVER (o ROWS UNBOUNDED PRECEDING) AS cum, sum(q) OVER (PARTITION BY s1_id) AS tot, sum(ln(1 - least(q, 1 - 1e-9))) OVER (PARTITION BY s1_id) AS log_none
  FROM pre WINDOW o AS (PARTITION BY s1_id ORDER BY p DESC, src, tgt_id)),
efs AS (SELECT *, CASE WHEN q >= {RULE.min_p} THEN 1.25 * cum / (k + 0.25 * (tot + {RULE.miss})) ELSE -1.0 END AS ef FROM sums),
best AS (SELECT s1_id, max(ef) AS bef, arg_max(k, (ef, -k)) AS bk, any_value({RULE.w0} * exp(log_none) * (1 - {RULE.miss})) AS e0 FROM efs GROUP BY s1_id),
kept AS (SELECT efs.*, k <= CASE WHEN e0 >= bef THEN 0 ELSE bk END AS keep0 FROM efs JOIN best USING (s1_id)),
dec AS (SELECT *, keep0 AND row_number() OVER (PARTITION BY src, tgt_id, keep0 ORDER BY p DESC, s1_id) = 1 AS keep FROM kept),
y AS (SELECT s1_id, count(*) AS g FROM truth GROUP BY s1_id),
es AS (
  SELECT s1_id, country, coalesce(tp, 0) AS tp, coalesce(pn, 0) AS pn, coalesce(g, 0) AS g, coalesce(reach, 0) AS reach,
    CASE WHEN coalesce(pn, 0) + coalesce(g, 0) = 0 THEN 1.0 ELSE 1.25 * coalesce(tp, 0) / (coalesce(pn, 0) + 0.25 * coalesce(g, 0)) END AS f05
  FROM ents LEFT JOIN (SELECT d.s1_id, count(*) FILTER (keep AND t.s1_id IS NOT NULL) AS tp, count(*) FILTER (keep) AS pn, count(t.s1_id) AS reach
    FROM dec d LEFT JOIN truth t ON t.s1_id = d.s1_id AND t.tgt_id = d.tgt_id GROUP BY d.s1_id) USING (s1_id) LEFT JOIN y USING (s1_id))
"""


def query(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# --- Spark side of the blocks ---


def _keys(spark: SparkSession, d: str, whole: bool = False, sets: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records and their keys.  whole: addresses are read later; else they go once their tokens are numbers.  sets: so are these numbers."""
    full = fixture.records(spark, d)
    rec = full if whole else fixture.without_addresses(full)
    stats = blocking.numbered(blocking.token_df(full, "addr_norm"))
    rec.kinweave_sets = blocking.token_sets(full, "addr_norm", stats, "[0-9]", ("name_core",), spent=not whole)
    keys = materialise(blocking.block_keys(rec, blocking.token_df(rec, "name_tokens"), stats, addr_sets=rec.kinweave_sets))
    discard(stats)
    if not sets:
        discard(rec.kinweave_sets)
    rec.kinweave_keys = keys
    return rec, keys


def _pairs(spark: SparkSession, d: str, whole: bool = False, sets: bool = False) -> tuple[DataFrame, DataFrame]:
    rec, keys = _keys(spark, d, whole, sets)
    return rec, blocking.candidate_pairs(keys, blocking.usable_keys(keys, SETTINGS, 0))


def _names_met() -> list[Column]:
    """Both sides' name_tokens, in _met()."""
    return [fixture.words(f"{x}_name_core") for x in "ab"]


def _met(rec: DataFrame, pairs: DataFrame, *columns: Column) -> DataFrame:
    """pairs with columns over both sides' name_core and sets of address tokens."""
    out = blocking.meet(pairs, rec.kinweave_sets.drop("ranked"), *columns)
    discard(rec.kinweave_sets)
    return out


def _scores() -> list[Column]:
    """cos_name and cos_addr, over both sides' name_core and sets of address tokens."""
    both = blocking.n_shared("a_", "b_")
    name = F.coalesce(features.jaccard(*_names_met()), F.lit(0.0))
    place = F.coalesce(both / F.nullif(F.col("a_n") + F.col("b_n") - both, F.lit(0)), F.lit(0.0))
    return [name.alias("cos_name"), place.alias("cos_addr")]


def _cheap(met: DataFrame) -> DataFrame:
    return met.withColumn("cheap", F.round(F.lit(SETTINGS.name_weight) * F.col("cos_name") + F.lit(1 - SETTINGS.name_weight) * F.col("cos_addr"), 6))


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rec, pairs = _pairs(spark, d, sets=True)
    return rec, _cheap(_met(rec, pairs, *_scores()))


def _top(spark: SparkSession, d: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    rec, keys = _keys(spark, d, whole, sets=True)
    out = blocking.best_pairs(keys, blocking.usable_keys(keys, SETTINGS, 0), rec.kinweave_sets.drop("ranked"), _scores(), _cheap, SETTINGS)
    discard(rec.kinweave_sets)
    return rec, out


def _p(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rec, top = _top(spark, d)
    return rec, top.select("s1_id", "src", "tgt_id", "country", "key_mask", F.col("cheap").alias("p"))


def _entities(rec: DataFrame) -> DataFrame:
    return rec.where("src = 1").select(F.col("entity_id").alias("s1_id"), "country")


def _decided(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rec, p = _p(spark, d)
    return rec, decide.decide(p, RULE)


# --- statistics and keys ---


@query("token_df", SQL_STATS + "SELECT token, df FROM name_df")
def token_df(spark: SparkSession, d: str) -> DataFrame:
    return blocking.token_df(fixture.records(spark, d), "name_tokens")


@query("token_idf", SQL_STATS + "SELECT token, round(ln((n + 1) / (df + 1)), 6) AS idf FROM addr_df, (SELECT count(*) AS n FROM rec)")
def token_idf(spark: SparkSession, d: str) -> DataFrame:
    rec = fixture.records(spark, d)
    n = rec.agg(F.count("*").alias("n"))
    return blocking.token_df(rec, "addr_tokens").join(F.broadcast(n)).select("token", F.round(blocking.idf(F.col("df"), F.col("n")), 6).alias("idf"))


@query("rarest_token", SQL_KEYS + "SELECT entity_id, r[1] AS rarest, len(r) AS n FROM nr")
def rarest_token(spark: SparkSession, d: str) -> DataFrame:
    rec = fixture.records(spark, d)
    ranked = blocking.rarest_first(rec, "name_tokens", blocking.token_df(rec, "name_tokens"), 2)
    return ranked.select("entity_id", F.get("ranked", F.lit(0)).alias("rarest"), F.size("ranked").cast("long").alias("n"))


@query("block_keys", SQL_KEYS + "SELECT entity_id, kt::INTEGER AS kt, key FROM keys")
def block_keys(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d)[1].select("entity_id", F.col("kt").cast("int").alias("kt"), "key")


@query("block_sizes", SQL_USABLE + "SELECT key, tgt_src::INTEGER AS tgt_src, a, b FROM sizes")
def block_sizes(spark: SparkSession, d: str) -> DataFrame:
    return blocking.key_sizes(_keys(spark, d)[1]).select("key", F.col("tgt_src").cast("int").alias("tgt_src"), "a", "b")


@query("usable_keys", SQL_USABLE + "SELECT key, tgt_src::INTEGER AS tgt_src, a * b AS n_pairs FROM usable")
def usable_keys(spark: SparkSession, d: str) -> DataFrame:
    return blocking.usable_keys(_keys(spark, d)[1], SETTINGS, 0).select("key", F.col("tgt_src").cast("int").alias("tgt_src"), (F.col("a") * F.col("b")).alias("n_pairs"))


@query("candidate_pairs", SQL_PAIRS + "SELECT s1_id, tgt_id, src::INTEGER AS src, key_mask, n_keys FROM pairs")
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)[1].select("s1_id", "tgt_id", F.col("src").cast("int").alias("src"), "key_mask", F.col("n_keys").cast("long").alias("n_keys"))


@query("cheap_scores", SQL_SCORED + "SELECT s1_id, tgt_id, round(cos_name, 6) AS cos_name, round(cos_addr, 6) AS cos_addr, cheap FROM cheap")
def cheap_scores(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _scored(spark, d)[1].select("s1_id", "tgt_id", r("cos_name"), r("cos_addr"), "cheap")


@query("topk_per_entity", SQL_SCORED + "SELECT s1_id, tgt_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, src ORDER BY cheap DESC, tgt_id) AS rn FROM cheap) WHERE rn <= 3")
def topk_per_entity(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d)[1]
    return scored.withColumn("rn", blocking.rank(["s1_id", "src"], F.desc("cheap"), F.col("tgt_id")).cast("long")).where("rn <= 3").select("s1_id", "tgt_id", "rn")


@query("topk_union3", SQL_TOP + "SELECT s1_id, tgt_id, cheap, rank_cheap FROM topk")
def topk_union3(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d)[1].select("s1_id", "tgt_id", "cheap", F.col("rank_cheap").cast("long").alias("rank_cheap"))


GRAMS = """,
gw AS (SELECT src, entity_id, unnest(nt) AS w FROM rec),
gc AS (SELECT src, entity_id, ' ' || w || ' ' AS w FROM gw),
gg AS (SELECT src, entity_id, unnest(list_transform(range(1, greatest(length(w) - 1, 1) + 1), lambda i: w[i:i + 1])) AS gram FROM gc
  UNION ALL SELECT src, entity_id, unnest(list_transform(range(1, length(w) - 1), lambda i: w[i:i + 2])) FROM gc WHERE length(w) >= 3
  UNION ALL SELECT src, entity_id, unnest(list_transform(range(1, length(w) - 2), lambda i: w[i:i + 3])) FROM gc WHERE length(w) >= 4),
gt AS (SELECT src, entity_id, gram, count(*) AS tf FROM gg GROUP BY ALL),
gd AS (SELECT gram, ln((1 + (SELECT count(*) FROM rec)) / (1 + count(*))) + 1 AS idf FROM gt GROUP BY gram HAVING count(*) >= 2),
gx AS (SELECT src, entity_id, gram, (1 + ln(tf)) * idf AS x FROM gt JOIN gd USING (gram)),
gn AS (SELECT src, entity_id, sqrt(sum(x * x)) AS len FROM gx GROUP BY ALL),
gv AS (SELECT gx.src, gx.entity_id, gram, x / len AS w FROM gx JOIN gn ON gx.src = gn.src AND gx.entity_id = gn.entity_id)
"""


@query(
    "tfidf_cosine",
    SQL_PAIRS + GRAMS + "SELECT s1_id, tgt_id, round(coalesce(sum(a.w * b.w), 0), 4) AS cos FROM pairs p LEFT JOIN gv a ON a.entity_id = p.s1_id LEFT JOIN gv b ON b.entity_id = p.tgt_id AND b.gram = a.gram GROUP BY ALL",
)
def tfidf_cosine(spark: SparkSession, d: str) -> DataFrame:
    rec, pairs = _pairs(spark, d)
    return blocking.text_cosine(pairs, rec, "name_core", 2, 4, "cos").select("s1_id", "tgt_id", F.round("cos", 4).alias("cos"))


# --- joins, sets, sorts, samples ---


@query("semi_join", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id", "source")


@query("anti_join", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("lookup_join_default", "SELECT o_orderkey, coalesce(c_mktsegment, '?') AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def lookup_join_default(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    return table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("?")).alias("segment"))


@query("truth_pairs", SQL_TOP + "SELECT s1_id, tgt_id FROM truth")
def truth_pairs(spark: SparkSession, d: str) -> DataFrame:
    return fixture.truth(fixture.records(spark, d)).distinct()


@query("label_pairs", SQL_TOP + "SELECT p.s1_id, p.tgt_id, (t.s1_id IS NOT NULL)::INTEGER AS y FROM p LEFT JOIN truth t ON t.s1_id = p.s1_id AND t.tgt_id = p.tgt_id")
def label_pairs(spark: SparkSession, d: str) -> DataFrame:
    rec, p = _p(spark, d)
    return learning.label_pairs(p, fixture.truth(rec)).select("s1_id", "tgt_id", "y")


@query("left_join_found", SQL_TOP + "SELECT t.s1_id, bool_and(p.tgt_id IS NOT NULL) AS all_found, count(*) AS n FROM truth t LEFT JOIN p ON t.s1_id = p.s1_id AND t.tgt_id = p.tgt_id GROUP BY t.s1_id")
def left_join_found(spark: SparkSession, d: str) -> DataFrame:
    rec, p = _p(spark, d)
    return report.all_found(report.found_matches(fixture.truth(rec), p))


@query("theta_better_count", SQL_TOP + "SELECT a.s1_id, a.tgt_id, count(*) AS n_better FROM topk a JOIN topk b ON a.s1_id = b.s1_id AND a.src = b.src AND b.cheap >= a.cheap GROUP BY ALL")
def theta_better_count(spark: SparkSession, d: str) -> DataFrame:
    top = _top(spark, d)[1].select("s1_id", "src", "tgt_id", "cheap")
    other = top.select("s1_id", "src", F.col("cheap").alias("kc"))
    return top.join(other, ["s1_id", "src"]).where(F.col("kc") >= F.col("cheap")).groupBy("s1_id", "tgt_id").agg(F.count("*").alias("n_better"))


@query("set_operations", SQL_PAIRS + """SELECT s1_id, tgt_id, len(list_intersect(a.nt, b.nt))::INTEGER AS n_both, len(list_distinct(list_concat(a.nt, b.nt)))::INTEGER AS n_any, list_has_any(a.adt, b.adt) AS touch
FROM pairs JOIN rec a ON a.entity_id = s1_id JOIN rec b ON b.entity_id = tgt_id""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    rec, pairs = _pairs(spark, d, sets=True)
    n = _names_met()
    met = _met(rec, pairs, F.size(F.array_intersect(*n)).alias("n_both"), F.size(F.array_union(*n)).alias("n_any"), (blocking.n_shared("a_", "b_") > 0).alias("touch"))
    return met.select("s1_id", "tgt_id", "n_both", "n_any", "touch")


WJ = SQL_PAIRS + """,
w AS (SELECT entity_id, token, ln((SELECT count(*) + 1 FROM rec) / (df + 1)) AS idf FROM (SELECT entity_id, unnest(list_distinct(nt)) AS token FROM rec) JOIN name_df USING (token)),
s AS (SELECT entity_id, sum(idf) AS total FROM w GROUP BY 1),
x AS (SELECT s1_id, tgt_id, sum(a.idf) AS shared FROM pairs JOIN w a ON a.entity_id = s1_id JOIN w b ON b.entity_id = tgt_id AND b.token = a.token GROUP BY ALL)
SELECT p.s1_id, p.tgt_id, round(coalesce(shared, 0) / (a.total + b.total - coalesce(shared, 0)), 6) AS wjacc, round(coalesce(shared, 0) / a.total, 6) AS cov_a
FROM pairs p JOIN s a ON a.entity_id = p.s1_id JOIN s b ON b.entity_id = p.tgt_id LEFT JOIN x ON x.s1_id = p.s1_id AND x.tgt_id = p.tgt_id"""


@query("weighted_jaccard", WJ)
def weighted_jaccard(spark: SparkSession, d: str) -> DataFrame:
    rec, pairs = _pairs(spark, d)
    n = rec.count()
    packed = features.with_token_idf(rec, "name_tokens", blocking.token_df(rec, "name_tokens"), n, "x").where("x IS NOT NULL")
    side = lambda s, i: packed.where(s).select(F.col("entity_id").alias(i), F.col("x").alias(f"x_{i}"))
    met = pairs.join(side("src = 1", "s1_id"), "s1_id").join(side("src > 1", "tgt_id"), "tgt_id")
    f = features.token_set_features(F.col("x_s1_id"), F.col("x_tgt_id"), "name", n)
    return met.select("s1_id", "tgt_id", F.round(f["name_wjacc"], 6).alias("wjacc"), F.round(f["name_cov_a"], 6).alias("cov_a"))


@query("union_all_distinct", "SELECT DISTINCT source, lang FROM (SELECT source, lang FROM documents UNION ALL SELECT source, lang FROM documents)")
def union_all_distinct(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "documents").select("source", "lang")
    return one.unionByName(one).distinct()


@query("strat_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 3")
def strat_sample(spark: SparkSession, d: str) -> DataFrame:
    return report.stratified(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", 3, F.desc("n_chars"), "doc_id").select("source", "doc_id")


@query("hash_split")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return learning.hash_split(table(spark, d, "events"), "event_id", {"fit": 0.8, "tune": 0.1, "check": 0.1}).groupBy("split", "event_type").agg(F.count("*").alias("n"))


@query("strided_sample", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) WHERE rn % 10 = 1")
def strided_sample(spark: SparkSession, d: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    return table(spark, d, "events").select("event_id", "event_type").withColumn("rn", rn).where("rn % 10 = 1").select("event_id")


# --- predicates and scalar functions ---


@query("eq_tristate", "SELECT p_partkey, CASE WHEN p_brand = '' OR b = '' THEN NULL ELSE (p_brand = b)::INTEGER END AS same FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN p_brand ELSE p_type END AS b FROM part)")
def eq_tristate(spark: SparkSession, d: str) -> DataFrame:
    other = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.col("p_brand")).otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", features.agree(F.col("p_brand"), other).cast("int").alias("same"))


PHON = """WITH t AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS s FROM part),
u AS (SELECT p_partkey, REPL AS s FROM t), v AS (SELECT p_partkey, string_split(s[1] || regexp_replace(s[2:], '[aeiouy]', '', 'g'), '') AS c FROM u)
SELECT p_partkey, array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: i = 1 OR c[i] <> c[i - 1]), lambda i: c[i]), '') AS sound FROM v"""


def _nested(pairs: list[tuple[str, str]]) -> str:
    out = "s"
    for a, b in pairs:
        out = f"replace({out}, '{a}', '{b}')"
    return out


@query("phonetic_key", PHON.replace("REPL", _nested(text.tables.PHONETIC)))
def phonetic_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.phonetic_key(F.col("p_name")).alias("sound"))


@query(
    "skeleton",
    "WITH t AS (SELECT p_partkey, lower(p_name) AS s FROM part), v AS (SELECT p_partkey, string_split(s[1] || regexp_replace(s[2:], '[aeiouhwy0-9]', '', 'g'), '') AS c FROM t) "
    "SELECT p_partkey, array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: i = 1 OR c[i] <> c[i - 1]), lambda i: c[i]), '')[1:5] AS skel FROM v",
)
def skeleton(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.skeleton(F.lower("p_name")).alias("skel"))


@query("base_clean")
def base_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.tokens(text.base_clean(F.col("url"))).alias("words"))


NAMES = "(SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part)"


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))


@query("levenshtein_sim", f"SELECT p_partkey, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS sim FROM {NAMES}")
def levenshtein_sim(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("p_partkey", F.round(text.key_similarity(F.col("a"), F.col("b")), 6).alias("sim"))


@query("jaro_winkler", f"SELECT p_partkey, round(100 * jaro_winkler_similarity(a, b), 4) AS jw FROM {NAMES}")
def jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("p_partkey", F.round(similarity.pair_similarity("jw", F.col("a"), F.col("b")), 4).alias("jw"))


@query("string_similarities")
def string_similarities(spark: SparkSession, d: str) -> DataFrame:
    sims = [F.round(similarity.pair_similarity(k, F.col("a"), F.col("b")), 4).alias(k) for k in ("ratio", "tsort", "tset", "partial")]
    return _names(spark, d).select("p_partkey", *sims)


@query("row_cosine", """WITH a AS (SELECT vec_id, embedding AS e FROM embeddings) SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))
/ sqrt(list_sum(list_transform(a.e, lambda v: v::DOUBLE * v::DOUBLE)) * list_sum(list_transform(b.e, lambda v: v::DOUBLE * v::DOUBLE))), 5) AS cos FROM a JOIN a b ON b.vec_id = a.vec_id + 1""")
def row_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    met = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return met.select("vec_id", F.round(dot("e", "f") / F.sqrt(dot("e", "e") * dot("f", "f")), 5).alias("cos"))


# --- aggregates ---


@query("value_counts", SQL_RECORDS + "SELECT array_to_string(nt, ' ') AS name_core, count(*) AS cnt FROM rec WHERE src = 1 GROUP BY 1")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return blocking.value_counts(fixture.records(spark, d).where("src = 1"), "name_core")


@query("vocab_topn", SQL_RECORDS + "SELECT word, count(*) AS cnt FROM (SELECT unnest(nt) AS word FROM rec) WHERE regexp_matches(word, '^[a-z]{2,}$') GROUP BY 1 HAVING count(*) >= 2 ORDER BY cnt DESC, word LIMIT 200")
def vocab_topn(spark: SparkSession, d: str) -> DataFrame:
    return learning.vocabulary(fixture.records(spark, d).select(F.explode("name_tokens").alias("word")), 2, 200)


@query("percentiles", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY 1")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_quantity", F.lit(0.5)).alias("p50"), F.percentile("l_quantity", F.lit(0.9)).alias("p90"))


@query("rollup_lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))


VOTES = SQL_RECORDS + ", v AS (SELECT nt[1] AS word, nt[2] AS value FROM rec WHERE len(nt) > 1), c AS (SELECT word, value, count(*) AS cnt FROM v GROUP BY ALL), r AS (SELECT *, sum(cnt) OVER (PARTITION BY word) AS total, row_number() OVER (PARTITION BY word ORDER BY cnt DESC, value) AS rn FROM c) SELECT word, value, cnt FROM r WHERE rn = 1 AND cnt >= 2 AND cnt >= 0.1 * total"


@query("dictionary_votes", VOTES)
def dictionary_votes(spark: SparkSession, d: str) -> DataFrame:
    rec = fixture.records(spark, d).where(F.size("name_tokens") > 1)
    return learning.dictionary_votes(rec.select(F.get("name_tokens", F.lit(0)).alias("word"), F.get("name_tokens", F.lit(1)).alias("value")), 2, 0.1)


ABBREV = SQL_PAIRS + """,
m AS (SELECT list_distinct(a.nt) AS l, list_distinct(b.nt) AS r FROM pairs JOIN rec a ON a.entity_id = s1_id JOIN rec b ON b.entity_id = tgt_id),
seen AS (SELECT short, count(*) AS seen FROM (SELECT unnest(list_distinct(list_concat(l, r))) AS short FROM m) GROUP BY 1),
alone AS (SELECT list_filter(l, lambda w: NOT list_contains(r, w)) AS a, list_filter(r, lambda w: NOT list_contains(l, w)) AS b FROM m),
xy AS (SELECT x, unnest(b) AS y FROM (SELECT unnest(a) AS x, b FROM alone)),
sl AS (SELECT x AS short, y AS long FROM xy UNION ALL SELECT y, x FROM xy),
ok AS (SELECT * FROM sl WHERE length(short) >= 2 AND length(short) < length(long) AND regexp_full_match(short, '[a-z]+') AND regexp_full_match(long, '[a-z]+') AND regexp_matches(long, '^' || array_to_string(string_split(short, ''), '.*'))),
c AS (SELECT short, long, count(*) AS cnt FROM ok GROUP BY ALL),
r AS (SELECT *, sum(cnt) OVER (PARTITION BY short) AS total, row_number() OVER (PARTITION BY short ORDER BY cnt DESC, long) AS rn FROM c)
SELECT short, long, cnt FROM r JOIN seen USING (short) WHERE rn = 1 AND cnt >= 2 AND cnt >= 0.5 * total AND long NOT IN (SELECT short FROM c) AND cnt >= 0.01 * seen"""


@query("abbrev_mining", ABBREV)
def abbrev_mining(spark: SparkSession, d: str) -> DataFrame:
    rec, pairs = _pairs(spark, d)
    side = lambda s, i, n: rec.where(s).select(F.col("entity_id").alias(i), F.col("name_tokens").alias(n))
    met = pairs.join(side("src = 1", "s1_id", "left"), "s1_id").join(side("src > 1", "tgt_id", "right"), "tgt_id")
    none = spark.range(0).select(F.col("id").cast("string").alias("word"))
    return learning.mine_abbreviations(met.select("left", "right"), none, 2, 0.5, 0.01)


# --- context and decisions ---

CTX = SQL_TOP + """,
c AS (SELECT *, row_number() OVER o AS rn, max(p) OVER g AS best, count(*) OVER g AS n, coalesce(nth_value(p, 2) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS second,
  sum(p) OVER (PARTITION BY s1_id) AS sum_e, count(*) FILTER (p > 0.5) OVER (PARTITION BY s1_id) AS hi_e FROM p WINDOW g AS (PARTITION BY VIEW), o AS (PARTITION BY VIEW ORDER BY p DESC, TIE))
"""


@query("context_rank_gap", CTX.replace("VIEW", "s1_id, src").replace("TIE", "tgt_id") + "SELECT s1_id, tgt_id, rn AS rank, round(best - p, 6) AS gap, n, round(CASE WHEN rn = 1 THEN p - second ELSE p - best END, 6) AS margin, round(sum_e, 6) AS sum_e, hi_e FROM c")
def context_rank_gap(spark: SparkSession, d: str) -> DataFrame:
    c = context.context_features(_p(spark, d)[1], reverse=False)
    return c.select("s1_id", "tgt_id", F.col("ctx_rank_es").cast("long").alias("rank"), F.round("ctx_gap_es", 6).alias("gap"), F.col("ctx_n_es").alias("n"), F.round("ctx_margin_es", 6).alias("margin"), F.round("ctx_sum_e", 6).alias("sum_e"), F.col("ctx_n_hi_e").alias("hi_e"))


@query("context_reverse", CTX.replace("VIEW", "src, tgt_id").replace("TIE", "s1_id") + "SELECT s1_id, tgt_id, rn AS rank, round(best - p, 6) AS gap, n, round(CASE WHEN rn = 1 THEN p - second ELSE p - best END, 6) AS margin FROM c")
def context_reverse(spark: SparkSession, d: str) -> DataFrame:
    c = context.context_features(_p(spark, d)[1])
    return c.select("s1_id", "tgt_id", F.col("ctx_rank_rev").cast("long").alias("rank"), F.round("ctx_gap_rev", 6).alias("gap"), F.col("ctx_n_rev").alias("n"), F.round("ctx_margin_rev", 6).alias("margin"))


@query("other_source_best", SQL_TOP + "SELECT s1_id, tgt_id, CASE WHEN src = 2 THEN max(p) FILTER (src = 3) OVER (PARTITION BY s1_id) ELSE max(p) FILTER (src = 2) OVER (PARTITION BY s1_id) END AS other FROM p")
def other_source_best(spark: SparkSession, d: str) -> DataFrame:
    return context.context_features(_p(spark, d)[1], reverse=False).select("s1_id", "tgt_id", F.col("ctx_other_src_max").alias("other"))


@query("expected_f_decision", SQL_RULE + "SELECT s1_id, tgt_id FROM kept WHERE keep0")
def expected_f_decision(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d)[1]
    return decide.decide(p, decide.Rule(**(vars(RULE) | {"single_owner": False}))).where("keep").select("s1_id", "tgt_id")


@query("single_owner", SQL_RULE + "SELECT s1_id, tgt_id FROM dec WHERE keep")
def single_owner(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d)[1].where("keep").select("s1_id", "tgt_id")


@query("threshold_decision", SQL_TOP + "SELECT s1_id, tgt_id FROM p WHERE p::FLOAT >= 0.4::FLOAT")
def threshold_decision(spark: SparkSession, d: str) -> DataFrame:
    return decide.decide(_p(spark, d)[1], decide.Rule("threshold", t=0.4)).where("keep").select("s1_id", "tgt_id")


@query("macro_f05", SQL_RULE + "SELECT round(avg(f05), 6) AS macro_f05, count(*) AS n FROM es")
def macro_f05(spark: SparkSession, d: str) -> DataFrame:
    rec, dec = _decided(spark, d)
    return decide.macro_f05(dec, fixture.truth(rec), _entities(rec)).select(F.round("macro_f05", 6).alias("macro_f05"), "n")


_GRID_ROWS = ", ".join(f"({i}, '{r.mode}', {r.t}, {r.miss}, {r.w0}, {r.min_p}, {str(r.single_owner).lower()})" for i, r in enumerate(decide.rule_grid()))
GRID = SQL_TOP + f""",
rules(rule_id, mode, t, miss, w0, min_p, single_owner) AS (SELECT a::INT, b, c::DOUBLE, d::DOUBLE, e::DOUBLE, f::DOUBLE, g FROM (VALUES {_GRID_ROWS}) v(a, b, c, d, e, f, g)),
pre AS (SELECT s1_id, src, tgt_id, p, least(greatest(p, 0), 1) AS q, row_number() OVER o AS k, sum(least(greatest(p, 0), 1)) OVER (o ROWS UNBOUNDED PRECEDING) AS cum, sum(least(greatest(p, 0), 1)) OVER (PARTITION BY s1_id) AS tot,
  sum(ln(1 - least(least(greatest(p, 0), 1), 1 - 1e-9))) OVER (PARTITION BY s1_id) AS log_none FROM p WINDOW o AS (PARTITION BY s1_id ORDER BY p DESC, src, tgt_id)),
each AS (SELECT rule_id, pre.*, CASE WHEN q >= min_p THEN 1.25 * cum / (k + 0.25 * (tot + miss)) ELSE -1.0 END AS ef, w0 * exp(log_none) * (1 - miss) AS e0, mode, t, single_owner FROM pre, rules),
best AS (SELECT rule_id, s1_id, max(ef) AS bef, arg_max(k, (ef, -k)) AS bk FROM each GROUP BY ALL),
kept AS (SELECT each.* FROM each JOIN best USING (rule_id, s1_id) WHERE CASE WHEN mode = 'threshold' THEN p::FLOAT >= t::FLOAT ELSE e0 < bef AND k <= bk END),
own AS (SELECT * FROM kept QUALIFY NOT single_owner OR row_number() OVER (PARTITION BY rule_id, src, tgt_id ORDER BY p DESC, s1_id) = 1),
k2 AS (SELECT rule_id, own.s1_id, count(*) AS pn, count(tr.s1_id) AS tp FROM own LEFT JOIN truth tr ON tr.s1_id = own.s1_id AND tr.tgt_id = own.tgt_id GROUP BY ALL),
g AS (SELECT s1_id, count(*) AS g FROM truth GROUP BY 1),
got AS (SELECT r.rule_id, round(avg(CASE WHEN coalesce(pn, 0) + coalesce(g, 0) = 0 THEN 1.0 ELSE 1.25 * coalesce(tp, 0) / (coalesce(pn, 0) + 0.25 * coalesce(g, 0)) END), 6) AS macro_f05,
  round(coalesce(sum(tp), 0) / greatest(coalesce(sum(pn), 0), 1), 6) AS precision, round(coalesce(sum(tp), 0) / greatest(coalesce(sum(g), 0), 1), 6) AS recall, round(1 - count(pn) / count(*), 6) AS empty
  FROM rules r CROSS JOIN ents LEFT JOIN k2 ON k2.rule_id = r.rule_id AND k2.s1_id = ents.s1_id LEFT JOIN g ON g.s1_id = ents.s1_id GROUP BY r.rule_id),
placed AS (SELECT *, row_number() OVER (ORDER BY macro_f05 DESC, rule_id) = 1 AS best FROM got)
SELECT rules.*, macro_f05, precision, recall, empty, best, CASE WHEN best THEN macro_f05 END AS again FROM rules JOIN placed USING (rule_id)"""


@query("rule_grid", GRID)
def rule_grid(spark: SparkSession, d: str) -> DataFrame:
    rec, p = _p(spark, d)
    found = decide.tuned(p, fixture.truth(rec), _entities(rec))
    return found.select("rule_id", "mode", "t", "miss", "w0", "min_p", "single_owner", *[F.round(c, 6).alias(c) for c in ("macro_f05", "precision", "recall", "empty")], "best", F.round("again", 6).alias("again"))


@query("rule_search_full")
def rule_search_full(spark: SparkSession, d: str) -> DataFrame:
    rec, p = _p(spark, d)
    return decide.search_rules(p, fixture.truth(rec), _entities(rec)).select("rule_id", "mode", "t", "miss", "w0", "min_p", "single_owner", F.round("macro_f05", 6).alias("macro_f05"))


# --- reports ---

FOUND = SQL_TOP + ", fm AS (SELECT t.s1_id, t.tgt_id, e.country, t.tgt_id[2:2] AS tgt, p.key_mask, p.p IS NOT NULL AS found FROM truth t JOIN ents e USING (s1_id) LEFT JOIN p ON p.s1_id = t.s1_id AND p.tgt_id = t.tgt_id)"


def _found(spark: SparkSession, d: str) -> DataFrame:
    rec, p = _p(spark, d)
    marked = fixture.truth(rec).distinct().join(_entities(rec), "s1_id").withColumn("tgt", F.substring("tgt_id", 2, 1))
    return report.found_matches(marked, p.drop("country"))


@query("recall_grouping_sets", FOUND + " SELECT country, tgt, round(avg(found::INTEGER), 6) AS recall, count(*) AS n FROM fm GROUP BY GROUPING SETS ((country), (tgt), ())")
def recall_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return report.recall_by(_found(spark, d), "country", "tgt").select("country", "tgt", F.round("recall", 6).alias("recall"), "n")


@query("key_usefulness", FOUND + f" SELECT kt, count(*) FILTER (key_mask & (1 << i) <> 0) AS hits, count(*) FILTER (key_mask = 1 << i) AS only FROM (SELECT * FROM fm WHERE found), (SELECT unnest({blocking.KEY_TYPES}) AS kt, unnest(range(0, 11)) AS i) GROUP BY kt")
def key_usefulness(spark: SparkSession, d: str) -> DataFrame:
    return report.key_usefulness(_found(spark, d))


BUCKET = "CASE WHEN g = 0 AND pn > 0 THEN 'A' WHEN g > 0 AND pn = 0 AND reach = 0 THEN 'B' WHEN g > 0 AND pn = 0 THEN 'C' WHEN g > 0 AND pn > tp THEN 'D' WHEN g > 0 AND pn > 0 AND tp < g THEN 'E' END"


@query("loss_rollup", SQL_RULE + f", b AS (SELECT *, 1 - f05 AS loss, {BUCKET} AS bucket FROM es) SELECT country, count(*) AS n, round(avg(f05), 6) AS f05, " + ", ".join(f"round(sum(CASE WHEN bucket = '{x}' THEN loss ELSE 0 END) / count(*), 6) AS loss_{x.lower()}" for x in "ABCDE") + " FROM b GROUP BY ROLLUP (country)")
def loss_rollup(spark: SparkSession, d: str) -> DataFrame:
    rec, dec = _decided(spark, d)
    out = report.loss_table(report.loss_buckets(dec.drop("country"), fixture.truth(rec), _entities(rec)))
    return out.select("country", "n", *[F.round(c, 6).alias(c) for c in ("f05", *[f"loss_{x}" for x in "abcde"])])


@query("blocking_bound", SQL_TOP + ", g AS (SELECT s1_id, count(*) AS g FROM truth GROUP BY 1), k AS (SELECT p.s1_id, count(*) AS tp FROM p JOIN truth t ON t.s1_id = p.s1_id AND t.tgt_id = p.tgt_id GROUP BY 1) SELECT round(avg(CASE WHEN g IS NULL THEN 1.0 ELSE 1.25 * coalesce(tp, 0) / (coalesce(tp, 0) + 0.25 * g) END), 6) AS macro_f05 FROM ents LEFT JOIN g USING (s1_id) LEFT JOIN k USING (s1_id)")
def blocking_bound(spark: SparkSession, d: str) -> DataFrame:
    rec, p = _p(spark, d)
    return report.upper_bound(p, fixture.truth(rec), _entities(rec)).select(F.round("macro_f05", 6).alias("macro_f05"))


@query("field_agreement", SQL_TOP + "SELECT e.country, count(*) AS n, round(avg((a.nt = b.nt)::INTEGER), 6) AS eq_name FROM truth t JOIN ents e USING (s1_id) JOIN rec a ON a.entity_id = t.s1_id JOIN rec b ON b.entity_id = t.tgt_id GROUP BY 1")
def field_agreement(spark: SparkSession, d: str) -> DataFrame:
    rec = fixture.records(spark, d)
    out = report.field_agreement(fixture.truth(rec).distinct(), rec, ["name_core"], "country")
    return out.select("country", "n", F.round("eq_name_core", 6).alias("eq_name"))


@query("shared_share", SQL_RECORDS + ", s AS (SELECT country, array_to_string(nt, ' ') AS k FROM rec WHERE src = 1), c AS (SELECT *, count(*) OVER (PARTITION BY country, k) AS n FROM s WHERE k <> '') SELECT country, round(avg((n > 1)::INTEGER), 6) AS shared FROM c GROUP BY 1")
def shared_share(spark: SparkSession, d: str) -> DataFrame:
    return report.shared_share(fixture.records(spark, d).where("src = 1"), "country", "name_core").select("country", F.round("shared", 6).alias("shared"))


# --- files ---

GLUE = """WITH l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS o, text, role FROM conversations),
m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS rec FROM l)
SELECT conv_id, rec::BIGINT AS rec, string_agg(text, ' ' ORDER BY turn, text) AS text, count(*)::INTEGER AS n_lines FROM m WHERE rec > 0 GROUP BY conv_id, rec"""


@query("glue_lines", GLUE)
def glue_lines(spark: SparkSession, d: str) -> DataFrame:
    return sources.glue_lines(table(spark, d, "conversations"), ["conv_id"], "turn", F.col("role") == "user", "text")


@query("id_lists", SQL_RULE + "SELECT e.s1_id AS source1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM (SELECT DISTINCT s1_id FROM ents) e LEFT JOIN (SELECT s1_id, string_agg(tgt_id, ',' ORDER BY tgt_id) AS ids FROM (SELECT DISTINCT s1_id, tgt_id FROM dec WHERE keep) GROUP BY s1_id) USING (s1_id)")
def id_lists(spark: SparkSession, d: str) -> DataFrame:
    rec, dec = _decided(spark, d)
    return sources.id_lists(_entities(rec), dec.where("keep"))


# --- cleaning, features and models ---


@query("clean_records")
def clean_records(spark: SparkSession, d: str) -> DataFrame:
    from kinweave.functions.cleaning import clean_records as clean

    return clean(fixture.raw_records(spark, d)).select("entity_id", "name_core", "name_key", "addr_norm", "addr_house", "addr_state", "country_norm")


@query("pair_features")
def pair_features(spark: SparkSession, d: str) -> DataFrame:
    from kinweave.plans.linkage import candidates_and_features, clean

    out = candidates_and_features(clean(fixture.raw_records(spark, d)), SETTINGS)
    return out.select("s1_id", "tgt_id", *features.FEATURES)


def _document_features(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    n = F.greatest(F.regexp_count("text", F.lit(r"\S+")), F.lit(1))
    return docs.select("doc_id", F.col("quality").alias("y"), F.log1p(n.cast("double")).alias("words"), (F.length("text") / n).alias("length"), (F.regexp_count("text", F.lit("[#*$%&|!]")) / n).alias("marks"), (F.regexp_count("text", F.lit("[A-Z]")) / F.length("text")).alias("capitals"))


DOC_FEATURES = ["words", "length", "marks", "capitals"]


@query("gbt_scores")
def gbt_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _document_features(spark, d)
    model = learning.fit_trees(rows, DOC_FEATURES, trees=8, depth=3)
    return learning.score_trees(model, rows, DOC_FEATURES).select("doc_id", "y", F.round("p", 6).alias("p"))


@query("isotonic")
def isotonic(spark: SparkSession, d: str) -> DataFrame:
    # The more marks, the likelier a document is a poor one.
    scored = _document_features(spark, d).select("doc_id", (1 - F.col("y")).alias("y"), F.col("marks").alias("p"))
    return learning.calibrate(learning.fit_isotonic(scored), scored).select("doc_id", "y", F.round("p", 6).alias("p"))
