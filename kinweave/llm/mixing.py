"""Mixing sources to target weights by temperature, in DataFrame operations only.

Source shares are raised to an exponent between 0 (all alike) and 1 (as they are).  It is bisected to the
greatest one whose weights still have the target entropy, or further up until no source is repeated more often
than the limit allows.  The normalised weights become token budgets, and a budget becomes whole permutations of
the source's blocks, plus as much of one more permutation as it pays for, to the document.  A block is a hash class of
documents, so a hot source is spread over all its blocks; what is ordered are block tables, and the documents of one small
part of one block of each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .native import WHITE, group_key, let

BLOCKS, ENTROPY_SHARE, MAX_REPEATS, SEED, STEPS = 256, 0.95, 4.0, 7, 50
#: Rows of the plan that are broadcast at most (under 100 bytes each); a larger plan is joined by a shuffle.
BROADCAST_ROWS = 200_000


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WHITE.replace("[", "[^")))


def hash_text(*parts: Column) -> Column:
    """32 bits of the md5 of the parts, as a number: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def _least_exponent(good) -> Column:  # noqa: ANN001
    """By bisection over [0, 1]: the least exponent for which good holds, where it holds from some exponent on."""
    begin = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        return F.when(good(mid), F.struct(acc["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct(mid.alias("lo"), acc["hi"].alias("hi")))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), begin, step, lambda acc: acc["hi"])
    return F.when(good(F.lit(0.0)), F.lit(0.0)).otherwise(done)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def exponent(sizes: DataFrame, budget: float | None, entropy_share: float, max_repeats: float) -> DataFrame:
    """One row (n, total, budget, alpha, z) from sizes(tokens), a row for each source: 8 bytes each in one array."""
    one = sizes.agg(F.array_sort(F.collect_list(F.col("tokens").cast("double"))).alias("t"))
    one = one.select("t", _sum(F.col("t")).alias("total")).where("total > 0")
    one = one.withColumn("p", F.transform("t", lambda x: x / F.col("total"))).withColumn("budget", F.lit(budget).cast("double") if budget else F.col("total"))
    p = F.col("p")
    power = lambda a: F.transform(p, lambda x: F.pow(x, a))
    entropy = lambda a: let(_sum(power(a)), lambda z: F.log(z) - _sum(F.transform(p, lambda x: F.pow(x, a) * a * F.log(x))) / z)
    want = F.log(F.size(p).cast("double")) * entropy_share
    # Entropy falls as the exponent grows: the least exponent that misses the target is where it is met.
    by_entropy = F.when(entropy(F.lit(1.0)) >= want, F.lit(1.0)).otherwise(_least_exponent(lambda a: entropy(a) < want))
    repeats = lambda a: let(_sum(power(a)), lambda z: F.array_max(F.transform(p, lambda x: F.pow(x, a) / z * F.col("budget") / (x * F.col("total")))))
    by_repeats = _least_exponent(lambda a: repeats(a) <= max_repeats)
    alpha = F.greatest(by_entropy, by_repeats)
    return one.select(F.size(p).alias("n"), "total", "budget", alpha.alias("alpha"), "p").select("n", "total", "budget", "alpha", _sum(F.transform("p", lambda x: F.pow(x, F.col("alpha")))).alias("z"))


def doc_key() -> Column:
    """What a document's places are drawn by: its id, or its text's digest where it has none."""
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit(""))


def _spot(seed: int, epoch: Column, key: Column) -> Column:
    """A document's place within its block in an epoch, as text that sorts: the same in any SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key).cast("binary"))


#: Sums of tokens are whole numbers: half of one keeps rounding errors from drawing or dropping a document.
HALF = 0.5


def _cuts(docs: DataFrame, open_: DataFrame, seed: int, few: bool) -> DataFrame:
    """(__src, block, cut) for each source's last, partly drawn block: its documents up to the spot `cut` are drawn.

    open_(__src, block, epoch, rest) has a row a source at most.  Spots are summed by their first two digits, then only
    documents with the two digits at which the budget ends are ordered: a 65,536th of a source by default.
    """
    small = F.broadcast if few else (lambda df: df)
    spot = _spot(seed, F.col("epoch"), F.col("__key"))
    inside = docs.select("__src", "block", "__key", "text").join(small(open_), ["__src", "block"]).select("__src", "block", "rest", spot.alias("spot"), tokens(F.col("text")).alias("n"))
    part = F.substring("spot", 1, 2)
    sums = materialise(inside.groupBy("__src", "block", "rest", part.alias("part")).agg(F.sum("n").alias("n")))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # At most 256 rows to a source in this window.
    started = sums.withColumn("start", before(Window.partitionBy("__src").orderBy("part"))).where(F.col("start") < F.col("rest") - HALF)
    last = started.groupBy("__src").agg(F.max_by(F.struct("part", "start"), "part").alias("l")).select("__src", "l.part", "l.start")
    near = inside.withColumn("part", part).join(small(last), ["__src", "part"]).groupBy("__src", "block", "rest", "start", "spot").agg(F.sum("n").alias("n"))
    drawn = near.withColumn("begin", F.col("start") + before(Window.partitionBy("__src").orderBy("spot"))).where(F.col("begin") < F.col("rest") - HALF)
    return materialise(drawn.groupBy("__src", "block").agg(F.max("spot").alias("cut")))


def mix(docs: DataFrame, budget: float | None = None, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """The mixture: every column of docs, and epoch, block, place; a row for each time that a document is drawn.

    docs has doc_id, text and source.  Tokens are words between white space.  budget: tokens to draw, by default as
    many as there are.  A source is drawn floor(budget / tokens) times as a whole and then in part; place is the
    block's rank in its epoch's permutation.  The last permutation's blocks are drawn while the budget lasts; where it
    ends within a block, that block's documents are drawn in hash order, up to the one at which the budget is met.  So
    every source with a weight has rows, and exceeds its budget by less than one document.  If the limit on repeats
    can't be met even with natural shares, those are used.  Null source is a source of its own; a source without any
    token has no weight and is left out.  Rows of one doc_id, and rows without one that share their text, are drawn
    together; columns named epoch, block or place are replaced; an empty table gives an empty result.
    """
    docs = docs.drop("epoch", "block", "place")
    own = docs.withColumns({"__src": group_key("source"), "__key": doc_key()}).withColumn("block", hash_text(F.lit(str(seed)), F.col("__key")) % blocks)
    sizes = materialise(own.groupBy("__src", "block").agg(F.sum(tokens(F.col("text"))).alias("tokens")))
    per = sizes.groupBy("__src").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    found = exponent(per, budget, entropy_share, max_repeats).first()
    n, total, asked, alpha, z = found if found else (0, 1.0, 0.0, 1.0, 1.0)
    # As the drawn share of a source, this many epochs begin.
    drawn = F.pow(F.col("all") / total, F.lit(alpha)) / z * asked / F.col("all")
    # At most `blocks` rows to a source in each window.
    source = Window.partitionBy("__src")
    table = sizes.withColumn("all", F.sum("tokens").over(source)).where("all > 0").withColumn("drawn", drawn)
    epochs = table.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor("drawn").cast("int"))))
    order = Window.partitionBy("__src", "epoch").orderBy(hash_text(F.lit(str(seed)), F.col("epoch").cast("string"), F.col("__src"), F.col("block").cast("string")), "block")
    left = (F.col("drawn") - F.col("epoch")) * F.col("all")
    placed = epochs.withColumns({"place": F.row_number().over(order) - 1, "upto": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)), "left": left})
    plan = materialise(placed.where(F.col("upto") - F.col("tokens") < F.col("left") - HALF).select("__src", "block", "epoch", "place", (F.col("left") - (F.col("upto") - F.col("tokens"))).alias("rest"), (F.col("upto") > F.col("left") + HALF).alias("open")))
    few = n * blocks * (max(max_repeats, asked / total) + 1) <= BROADCAST_ROWS
    cuts = _cuts(own, plan.where("open").select("__src", "block", "epoch", "rest"), seed, few)
    plan = plan.drop("rest").join(cuts.withColumn("open", F.lit(True)), ["__src", "block", "open"], "left").select("__src", "block", "epoch", "place", "cut")
    met = own.join(F.broadcast(plan) if few else plan, ["__src", "block"])
    taken = met.where(F.when(F.col("cut").isNull(), True).otherwise(_spot(seed, F.col("epoch"), F.col("__key")) <= F.col("cut")))
    return taken.select(*docs.columns, "epoch", "block", "place")


def shares(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """(source, tokens, drawn): each source's tokens in docs and in a mixture of them, to compare with the target weights."""
    count = lambda df, name: df.groupBy("source").agg(F.sum(tokens(F.col("text"))).alias(name))
    own, got = count(docs, "tokens"), count(mixed, "drawn").withColumnRenamed("source", "__source")
    return own.join(got, own["source"].eqNullSafe(got["__source"]), "left").select("source", "tokens", F.coalesce("drawn", F.lit(0)).alias("drawn"))


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, src, key, CAST('0x' || substr(md5('{SEED}:' || key), 1, 8) AS BIGINT) % {BLOCKS} AS block, n FROM (
    SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS src, coalesce(CAST(doc_id AS VARCHAR), md5(text), '') AS key,
      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents)),
sizes AS (SELECT src, block, sum(n)::BIGINT AS tokens FROM d GROUP BY ALL),
per AS (SELECT src, sum(tokens)::DOUBLE AS t FROM sizes GROUP BY src HAVING sum(tokens) > 0),
p AS (SELECT t / (SELECT sum(t) FROM per) AS p FROM per),
want AS (SELECT ln(count(*)) * {ENTROPY_SHARE} AS e FROM per),
bis AS (
  SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS rlo, 1.0::DOUBLE AS rhi
  UNION ALL
  SELECT k + 1,
    CASE WHEN x.e < want.e THEN lo ELSE (lo + hi) / 2 END, CASE WHEN x.e < want.e THEN (lo + hi) / 2 ELSE hi END,
    CASE WHEN r <= {MAX_REPEATS} THEN rlo ELSE (rlo + rhi) / 2 END, CASE WHEN r <= {MAX_REPEATS} THEN (rlo + rhi) / 2 ELSE rhi END
  FROM bis, want,
    LATERAL (SELECT ln(sum(p ** ((lo + hi) / 2))) - sum(p ** ((lo + hi) / 2) * ((lo + hi) / 2) * ln(p)) / sum(p ** ((lo + hi) / 2)) AS e FROM p) x,
    LATERAL (SELECT max(p ** ((rlo + rhi) / 2) / p) / sum(p ** ((rlo + rhi) / 2)) AS r FROM p) y
  WHERE k < {STEPS}),
ends AS (SELECT ln(count(*)) AS e0, -sum(p * ln(p)) AS e1, max(1 / p) / count(*) AS r0 FROM p),
alpha AS (SELECT greatest(CASE WHEN e1 >= want.e THEN 1.0 WHEN e0 < want.e THEN 0.0 ELSE hi END, CASE WHEN r0 <= {MAX_REPEATS} THEN 0.0 ELSE rhi END) AS a FROM bis, ends, want WHERE k = {STEPS}),
drawn AS (SELECT src, t, (t / (SELECT sum(t) FROM per)) ** a / (SELECT sum(p ** a) FROM p) * (SELECT sum(t) FROM per) / t AS x FROM per, alpha),
epochs AS (SELECT s.src, block, tokens, t, x, unnest(range(0, floor(x)::BIGINT + 1)) AS epoch FROM sizes s JOIN drawn USING (src)),
placed AS (SELECT *, row_number() OVER w - 1 AS place, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM epochs
  WINDOW w AS (PARTITION BY src, epoch ORDER BY CAST('0x' || substr(md5('{SEED}:' || epoch || ':' || src || ':' || block), 1, 8) AS BIGINT), block)),
todo AS (SELECT src, block, epoch, place, (x - epoch) * t - (upto - tokens) AS rest, upto > (x - epoch) * t + 0.5 AS open FROM placed WHERE upto - tokens < (x - epoch) * t - 0.5),
spots AS (SELECT d.src, d.block, md5('{SEED}:' || epoch || ':' || key) AS spot, any_value(rest) AS rest, sum(n) AS n FROM d JOIN todo ON d.src = todo.src AND d.block = todo.block AND open GROUP BY ALL),
cuts AS (SELECT src, block, max(spot) AS cut FROM (SELECT *, sum(n) OVER (PARTITION BY src ORDER BY spot ROWS UNBOUNDED PRECEDING) - n AS start FROM spots) WHERE start < rest - 0.5 GROUP BY ALL)
SELECT doc_id, source, epoch::INTEGER AS epoch, d.block::BIGINT AS block, place::INTEGER AS place
FROM d JOIN todo ON d.src = todo.src AND d.block = todo.block LEFT JOIN cuts ON open AND cuts.src = d.src AND cuts.block = d.block
WHERE NOT open OR md5('{SEED}:' || epoch || ':' || key) <= cut
"""
