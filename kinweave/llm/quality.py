"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Each document gives a vector of transformed statistics.  Per (lang, source) a minimum-covariance-determinant
estimate is made over all its documents by concentration steps: take the COVERED share of documents with the least
Mahalanobis distances, estimate their mean and covariance, and again.  There are three starts: medians with median
deviations, the covariance of spatial signs, and plain moments.  After TRIAL_STEPS the start with the least
determinant goes on until the determinant settles.  A step is a few grouped aggregations with map-side partial
results, so a hot source is never gathered in a task.

Squared distances are made consistent by their median, as the covariance of a core is too small for the whole.  A group's
cut is the normal model's quantile of level LEVEL or, if that is further, the same level of a tail fitted to the group's
own distances: log-normal through their median and upper quartile, which up to a quarter of bad documents can't move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialise, raw_texts

#: Share of a group's documents that an estimate rests on; steps before the best start is chosen, steps at most, and the change of
#: the determinant's logarithm at which an estimate has settled.
COVERED, TRIAL_STEPS, MOST_STEPS, SETTLED = 0.75, 2, 20, 1e-3
NAMES = ["word_length", "symbols", "dup_lines", "repeats", "capitals", "shouts"]
#: What each statistic is a share of, and how many at once its things come.  The square root of a share of n things that come k
#: at once varies by k / (4 n) from counting alone; an estimate grants that much variance, on average of a group, as most
#: clean documents have no symbol or repeated line at all.  A repeated window puts six words at least: three at either place.
PER = dict(zip(NAMES, ["words", "words", "lines", "words", "letters", "words"]))
AT_ONCE = dict.fromkeys(NAMES, 1) | {"repeats": 6}
NOISES = ["words", "lines", "letters"]
#: The level is 0.999: one clean document in a thousand is rejected where the model holds.  Its normal quantile, and that of the
#: chi-squared distribution of six degrees; the latter's median; the normal upper quartile.
LEVEL_Z, LEVEL_CHI2, MEDIAN_CHI2, QUARTILE_Z = 3.0902, 22.458, 5.348, 0.6745
#: Documents that the tails of all groups count for in a group's own, as a few documents tell little of a tail.
PRIOR = 50
BROADCAST_GROUPS = 20_000
ACCURACY = 10_000
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_VECTOR = [*NAMES, *(f"{c}_noise" for c in NOISES)]
_WS = b" \t\n\r\x0b\x0c"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words in windows of `size` words that are found twice or more; numbers stand for words, in 8 bytes each."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    number = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    window = number[:n]
    for j in range(1, size):
        window, times = np.unique(window * len(seen) + number[j : j + n], return_inverse=True, return_counts=True)[1:]
    often = np.flatnonzero(times[window] > 1)
    if not len(often):
        return 0
    # Each window adds the words that the one before it does not cover.
    return size + int(np.minimum(np.diff(often), size).sum())


def statistics(raw: bytes) -> tuple[list[int], list[float]]:
    """The five counts of the base rules, and the vector of transformed statistics with their three counting noises."""
    words = raw.split()
    n = len(words)
    text = raw.decode("utf-8", "replace")
    inner = len(text) - (len(raw) - len(raw.translate(None, _WS)))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.strip(_WS)]
    repeats = repeated_words(words)
    dups = len(lines) - len(set(lines))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    lower = len(raw) - len(raw.translate(None, _LOWER))
    per = max(n, 1)
    vector = [
        math.log1p(inner / per),
        math.sqrt(symbols / per),
        math.sqrt(dups / max(len(lines), 1)),
        math.sqrt(repeats / per),
        math.sqrt(upper / max(upper + lower, 1)),
        math.sqrt(raw.count(b"!") / per),
        *(0.25 / max(x, 1) for x in (n, len(lines), upper + lower)),
    ]
    return [n, inner, symbols, dups, repeats], vector


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, grp (language and source), the counts and the vector of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x) for x in raw_texts(batch.column(2))]
            counts, vectors = zip(*rows) if rows else ((), ())
            c, v = np.array(counts, np.int64).reshape(-1, 5), np.array(vectors, np.float64).reshape(-1, len(_VECTOR))
            yield pa.record_batch([batch.column(0), batch.column(1), *map(pa.array, c.T.copy()), *map(pa.array, v.T.copy())], names=["doc_id", "grp", *_COUNTS, *_VECTOR])

    # Null and empty values stay apart: a present value gets a mark before it.
    grp = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in ("lang", "source")])
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}, grp string", *(f"{c} long" for c in _COUNTS), *(f"{c} double" for c in _VECTOR)])
    return map_arrow(docs.select("doc_id", grp.alias("grp"), "text"), run, schema)


_FLAT = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def _shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, start, center, cov, noise) -> (grp, start, center, w, size): w * (x - center) has unit covariance, size is ln det."""
    p = len(NAMES)
    for batch in batches:
        whites, sizes = [], []
        for lower, noise in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            cov = np.zeros((p, p))
            cov[np.tril_indices(p)] = lower
            # Rounding of sums may leave a core of equal vectors with a covariance of a hair below zero.
            spread, axes = np.linalg.eigh(cov + np.tril(cov, -1).T)
            root = np.linalg.cholesky((axes * np.maximum(spread, 0)) @ axes.T + np.diag(noise))
            whites.append(np.linalg.inv(root)[np.tril_indices(p)].tolist())
            sizes.append(2 * float(np.log(np.diag(root)).sum()))
        doubles = pa.list_(pa.float64())
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2).cast(doubles), pa.array(whites, doubles), pa.array(sizes, pa.float64())], names=["grp", "start", "center", "w", "size"])


def _distance() -> Column:
    """Squared Mahalanobis distance, from the joined center and w."""
    total, k = F.lit(0.0), 0
    for i in range(len(NAMES)):
        row = F.lit(0.0)
        for j in range(i + 1):
            row = row + F.col("w")[k] * (F.col(NAMES[j]) - F.col("center")[j])
            k += 1
        total = total + row * row
    return total


def _moments(rows: DataFrame, start: Column) -> DataFrame:
    """(grp, start, center, cov): means and covariances of rows by group and start."""
    mean = F.array(*[F.avg(c) for c in NAMES])
    cov = F.array(*[F.avg(F.col(NAMES[i]) * F.col(NAMES[j])) - F.avg(NAMES[i]) * F.avg(NAMES[j]) for i, j in _FLAT])
    return rows.groupBy("grp", start.alias("start")).agg(mean.alias("center"), cov.alias("cov"))


def _starts(stats: DataFrame, noise: DataFrame, small) -> DataFrame:  # noqa: ANN001
    """The three starting estimates of each group, before _shape."""
    middle = stats.groupBy("grp").agg(*[F.percentile_approx(c, 0.5, ACCURACY).alias(f"m_{c}") for c in NAMES])
    spread = stats.join(small(middle), "grp").groupBy("grp").agg(
        F.array(*[F.first(f"m_{c}") for c in NAMES]).alias("center"),
        F.array(*[F.percentile_approx(F.abs(F.col(c) - F.col(f"m_{c}")), 0.5, ACCURACY) * 1.4826 for c in NAMES]).alias("s"),
    )
    robust = materialise(spread.join(small(noise), "grp").withColumn("sd", F.transform("s", lambda x, i: F.sqrt(x * x + F.get("noise", i)))))
    medians = robust.select("grp", F.lit(0).alias("start"), "center", F.array(*[F.col("s")[i] * F.col("s")[j] if i == j else F.lit(0.0) for i, j in _FLAT]).alias("cov"))
    each = [(F.col(c) - F.col("center")[i]) / F.col("sd")[i] for i, c in enumerate(NAMES)]
    z = stats.join(small(robust.select("grp", "center", "sd")), "grp").select("grp", "center", "sd", F.array(*each).alias("z"))
    z = z.withColumn("far", F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x)))
    u = lambda i: F.when(F.col("far") > 0, F.col("z")[i] / F.col("far")).otherwise(0.0) * F.col("sd")[i]
    signs = z.groupBy("grp").agg(F.first("center").alias("center"), F.array(*[F.avg(u(i) * u(j)) * len(NAMES) for i, j in _FLAT]).alias("cov"))
    return medians.unionByName(signs.select("grp", F.lit(1).alias("start"), "center", "cov")).unionByName(_moments(stats, F.lit(2)))


def estimates(stats: DataFrame) -> DataFrame:
    """(grp, center, w, scale, cut) from all rows of stats.

    Tables with a row a group are broadcast up to BROADCAST_GROUPS rows (under 1 kB each); beyond, joined by a shuffle.
    """
    few = stats.select("grp").distinct().count() <= BROADCAST_GROUPS
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    noise = materialise(stats.groupBy("grp").agg(F.array(*[F.avg(f"{PER[c]}_noise") * AT_ONCE[c] for c in NAMES]).alias("noise")))
    shape = lambda df: materialise(map_arrow(df.join(small(noise), "grp").select("grp", "start", "center", "cov", "noise"), _shape, "grp string, start int, center array<double>, w array<double>, size double"))

    def step(now: DataFrame) -> DataFrame:
        far = stats.join(small(now), "grp").select("grp", "start", *NAMES, _distance().alias("d"))
        bound = far.groupBy("grp", "start").agg(F.percentile_approx("d", COVERED, ACCURACY).alias("bound"))
        return shape(_moments(far.join(small(bound), ["grp", "start"]).where("d <= bound"), F.col("start")))

    now = shape(_starts(stats, noise, small))
    for k in range(MOST_STEPS):
        after = step(now)
        if k + 1 == TRIAL_STEPS:
            best = after.groupBy("grp").agg(F.min_by(F.struct("start", "center", "w", "size"), F.struct("size", "start")).alias("b")).select("grp", "b.*")
            now, after = after, materialise(best)
        elif k + 1 > TRIAL_STEPS:
            moved = after.join(now.select("grp", F.col("size").alias("was")), "grp").agg(F.max(F.abs(F.col("size") - F.col("was")))).first()[0]
            if (moved or 0.0) < SETTLED:
                discard(now)
                now = after
                break
        discard(now)
        now = after
    tail = stats.join(small(now), "grp").groupBy("grp").agg(F.count("*").alias("n"), F.percentile_approx(_distance(), [0.5, 0.75], ACCURACY).alias("q"))
    ratio = F.log(F.greatest(F.col("q")[1], F.lit(1e-9)) / F.greatest(F.col("q")[0], F.lit(1e-9))) / QUARTILE_Z
    tail = materialise(tail.withColumn("width", ratio))
    usual = tail.agg(F.sum(F.col("n") * F.col("width")) / F.sum("n")).first()[0] or 0.0
    scale = F.greatest(F.lit(1.0), F.col("q")[0] / MEDIAN_CHI2)
    width = (F.col("n") * F.col("width") + PRIOR * usual) / (F.col("n") + PRIOR)
    cut = F.greatest(F.lit(LEVEL_CHI2), F.col("q")[0] / scale * F.exp(width * LEVEL_Z))
    return small(now.join(small(tail), "grp").select("grp", "center", "w", scale.alias("scale"), cut.alias("cut")))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance, cut), a row for each row of docs.

    docs has doc_id, text, lang and source; null lang or source is a group of its own.  Null text has no words
    and fails the base rules.  Estimates rest on rows that pass them; a group of one such row keeps it, and of equal rows all.
    Repeated rows count each; other columns are ignored; an empty table gives an empty result.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = materialise(measure(docs).withColumn("base_failed", failed))
    fitted = estimates(stats.where(~F.col("base_failed")))
    far = stats.join(fitted, "grp", "left").withColumn("distance", _distance() / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.col("cut"), F.lit(True))
    return far.select("doc_id", *_COUNTS, "base_failed", kept.alias("kept"), *[F.when(~F.col("base_failed"), F.col(c)).alias(c) for c in ("distance", "cut")])
