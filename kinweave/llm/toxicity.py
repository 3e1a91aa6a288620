"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are lexicon entries (whole words) and patterns (word beginnings, shouting, symbol runs), chosen for
their share of toxic texts among labelled rows.  The label model takes the votes on a sample of texts, labelled or
not, and estimates by expectation maximisation how often each voter fires on either class, and within the
classes how voters correlate; a voter's evidence is divided among those that say the same.  A logistic
classifier is trained on the posterior labels, and scores every text by the terms it holds.

Samples for fitting are bounded and hash-chosen; every whole text is scored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, fit_rows, map_arrow, raw_texts

#: Labelled rows of either class, and unlabelled rows, that are fitted on, about; bytes of their texts at most (a third for
#: each of the three, and a text may take a quarter of that; longer ones are not fitted on).
TOXIC_ROWS, CLEAN_ROWS, PLAIN_ROWS, FIT_BYTES = 1_200, 2_400, 600, 96 << 20
#: Terms at most; toxic texts that a term must be in, by level, as chance seldom repeats a word; the least share of
#: toxic ones among texts with it, smoothed.
TERMS, LEAST_TEXTS, LEAST_SHARE = 1_500, {"1": 6, "2": 3, "3": 3}, 0.75
PREFIXES = (4, 5, 6)
ROUNDS, STEPS, RIDGE = 10, 300, 2e-3
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
SHAPES = {"shout": re.compile(r"[A-Z]{2,}[!]+"), "symbols": re.compile(r"[#*$%&]{2,}")}
#: Levels beyond a single occurrence: the least share of a text's words.
RATES = {"2": 0.005, "3": 0.012}


def levels(count: int, words: int) -> list[str]:
    """How often a term is met: at all, more than chance would have it, or all over the text."""
    out = ["1"]
    for name, rate in RATES.items():
        if count >= 2 and count >= rate * words:
            out.append(name)
    return out


def shapes(text: str) -> list[str]:
    return [name for name, pattern in SHAPES.items() if pattern.search(text)]


def terms(raw: bytes) -> set[str]:
    """Every voter's name that a text could fire: words and word beginnings with their levels, and shapes."""
    text = raw.decode("utf-8", "replace")
    words = WORD.findall(text.lower())
    counts: Counter = Counter()
    for w, n in Counter(words).items():
        counts[f"w:{w}"] += n
        for k in PREFIXES:
            if len(w) >= k:
                counts[f"p:{w[:k]}"] += n
    return {f"{lv}{t}" for t, n in counts.items() for lv in levels(n, len(words))} | set(shapes(text))


class Reader:
    """Which of the known voters a text fires."""

    def __init__(self, names: list[str]):
        self.at = {n: i for i, n in enumerate(names)}
        plain = {n[1:] for n in names}
        self.words = {n[2:] for n in plain if n.startswith("w:")}
        self.starts = {k: {n[2:] for n in plain if n.startswith("p:") and len(n) == k + 2} for k in PREFIXES}
        self.heads = {x[: PREFIXES[0]] for s in self.starts.values() for x in s}

    def __call__(self, raw: bytes) -> list[int]:
        text = raw.decode("utf-8", "replace")
        words = WORD.findall(text.lower())
        counts: Counter = Counter()
        for w, n in Counter(words).items():
            if w in self.words:
                counts[f"w:{w}"] += n
            if w[: PREFIXES[0]] in self.heads:
                for k, starts in self.starts.items():
                    if w[:k] in starts and len(w) >= k:
                        counts[f"p:{w[:k]}"] += n
        fired = [f"{lv}{t}" for t, n in counts.items() for lv in levels(n, len(words))]
        return sorted(self.at[x] for x in [*fired, *shapes(text)] if x in self.at)


def sketch(raw: bytes) -> int:
    """The least hash of three words in a row: near copies of a text mostly have the same."""
    words = raw.split()
    return min((zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0)


def choose_terms(texts: list[bytes], toxic: np.ndarray, clean_weight: float, limit: int = TERMS) -> list[str]:
    """Terms of which LEAST_SHARE of the texts with them are toxic, at least; the most frequent first.

    A clean text counts clean_weight times, as samples thin out the classes unlike.  Of near copies one counts.
    """
    hits, others, seen = Counter(), Counter(), set()
    for raw, y in zip(texts, toxic):
        if (key := (bool(y), sketch(raw))) not in seen:
            seen.add(key)
            (hits if y else others).update(terms(raw))
    share = lambda n, m: n / (n + m * clean_weight + 1)
    good = [(n, t) for t, n in hits.items() if n >= LEAST_TEXTS.get(t[0], 6) and share(n, others[t]) >= LEAST_SHARE]
    good.sort(key=lambda x: (-x[0], x[1]))
    chosen = [t for _, t in good[:limit]]
    return chosen + [t for t in SHAPES if chosen and t not in chosen]


def votes(reader: Reader, texts: list[bytes], n: int) -> np.ndarray:
    x = np.zeros((len(texts), n), np.float32)
    for i, raw in enumerate(texts):
        x[i, reader(raw)] = 1
    return x


def label_model(v: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row of votes v, and the share of its evidence that each voter keeps.

    A voter that doesn't fire abstains; that none fires at all is a vote of its own.  known: 1, 0 or -1 for an
    unlabelled row.  Labels start the estimates and then hold as one more vote, not as facts.
    """
    v = np.hstack([v, (v.sum(axis=1, keepdims=True) == 0).astype(v.dtype)])
    q = np.where(known == 1, 0.95, np.where(known == 0, 0.02, 0.1))
    labelled = np.where(known == 1, np.log(0.9 / 0.1), np.where(known == 0, np.log(0.02 / 0.98), 0.0))
    keep = np.ones(v.shape[1])
    for _ in range(ROUNDS):
        rate = [(w @ v + 0.1) / (w.sum() + 1.0) for w in (q, 1 - q)]  # how often each voter fires on either class
        # Correlations within the classes, beyond what the class explains.
        both = np.zeros((v.shape[1], v.shape[1]))
        for w, p in zip((q, 1 - q), rate):
            mid = (v - p) * np.sqrt(w)[:, None]
            cov = mid.T @ mid / max(w.sum(), 1.0)
            sd = np.sqrt(np.clip(np.diag(cov), 1e-6, None))
            both = np.maximum(both, np.clip(cov / np.outer(sd, sd), 0, 1))
        np.fill_diagonal(both, 1.0)
        keep = 1 / np.where(both > 0.3, both, 0).sum(axis=1)
        prior = np.log(np.clip(q.mean(), 0.01, 0.99) / np.clip(1 - q.mean(), 0.01, 0.99))
        logit = prior + labelled + v @ (keep * np.log(rate[0] / rate[1]))
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q, keep[:-1]


def train(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Logistic weights, the constant last, for soft labels q: gradient descent with momentum."""
    x = np.hstack([v, np.ones((len(v), 1), np.float32)])
    weight = np.where(q > 0.5, 0.5 / max((q > 0.5).mean(), 1e-3), 0.5 / max((q <= 0.5).mean(), 1e-3))
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    rate = 4.0 / max(1.0, float(np.square(x).sum(axis=1).mean()))
    ridge = np.append(np.full(v.shape[1], RIDGE), 0)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed - rate * (x.T @ ((p - q) * weight) / len(x) + ridge * w)
        w = w + speed
    return w


def fit(texts: list[bytes], known: list[int], clean_weight: float = 1.0) -> dict:
    """names and weights (constant last) from texts with labels 1, 0 or -1 for none."""
    y = np.array(known)
    names = choose_terms([t for t, k in zip(texts, known) if k >= 0], y[y >= 0] == 1, clean_weight) if (y == 1).any() else []
    if not names:
        return {"names": [], "weights": [-3.0]}
    v = votes(Reader(names), texts, len(names))
    q, _ = label_model(v, y)
    return {"names": names, "weights": train(v, q).tolist()}


def fit_sample(docs: DataFrame, labels: DataFrame, held_out: int = 4) -> dict:
    """A model from bounded samples of labelled and unlabelled rows, none with crc32(doc_id) mod held_out = 2.

    The same for any partitions.  Of several labels of one doc_id the toxic one counts.
    """
    open_ = docs.where(F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), held_out) != 2)).select("doc_id", "text")
    marked = labels.where(F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), held_out) != 2)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    many = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    wanted = {1: TOXIC_ROWS, 0: CLEAN_ROWS, -1: PLAIN_ROWS}
    # Labels are thinned before the join, by twice the share that the rows are thinned by after it.
    draw = F.pmod(F.xxhash64(F.lit("label"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    least = {k: min(1.0, 2 * wanted[k] / max(many.get(k, 0), 1)) for k in (0, 1)}
    chosen = marked.where(draw < F.when(F.col("toxic") == 1, least[1]).otherwise(least[0]))
    known = fit_rows(open_.join(F.broadcast(chosen), "doc_id"), "toxic", wanted, {k: many.get(k, 0) * least[k] for k in (0, 1)}, FIT_BYTES * 2 // 3)
    plain = fit_rows(open_.withColumn("toxic", F.lit(-1)), "toxic", wanted, {-1: open_.count()}, FIT_BYTES // 3)
    rows = sorted(known + plain)
    thinned = [min(1.0, wanted[k] / max(many.get(k, 0), 1)) for k in (1, 0)]
    return fit([t for t, _ in rows], [k for _, k in rows], thinned[0] / thinned[1])


def score_texts(docs: DataFrame, model: dict, held_out: int = 4, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text).

    Null or empty text holds no term and gets the classifier's constant.  Repeated rows score alike; other columns
    are ignored; an empty table gives an empty result.  A model fitted without a toxic label scores all texts alike.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, w = Reader(held.value["names"]), np.array(held.value["weights"])
        for batch in batches:
            logit = np.array([w[-1] + w[read(x)].sum() for x in raw_texts(batch.column(1))])
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))), pa.float64())], names=["doc_id", "score"])

    scored = map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), held_out) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score_texts with a model fitted on docs and labels(doc_id, toxic)."""
    return score_texts(docs, fit_sample(docs, labels))
