"""Language identification in two steps: the family first, then the language within it.

Features are hashed byte n-grams of the lower-cased letters, as shares of all n-grams of the whole text.  A linear
support vector machine for each family against the rest gives the family; within it, one machine for each pair
of languages votes.  All machines are one weight table, so scoring is a sum of table rows over a text's n-grams.

The machines are fitted on a bounded, hash-chosen sample of labelled rows; every row is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import svm
from .common import crc_mod, fit_rows, map_arrow
from .wordhash import mix

#: Labelled rows that the machines are fitted on, about, and of one language; bytes of their texts at most (a language has
#: an equal share of them, and a text may take a quarter of that; longer ones are not fitted on); languages, the most
#: frequent ones.  They bound the driver's memory and the model: 32 kB a machine.
FIT_ROWS, FIT_ROWS_EACH, FIT_BYTES, LANGUAGES = 3_200, 800, 64 << 20, 200
GRAMS, HASH_BITS = (2, 3, 4), 13
STEP_BYTES = 1 << 19
UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")

# Families of ISO 639-1 codes.  Any other label is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indo-aryan": "hi bn mr gu pa ne si ur",
    "iranian": "fa ps ku tg",
    "semitic": "ar he am mt",
    "celtic": "ga gd cy br",
    "baltic": "lt lv",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def letters(raw: bytes | None) -> bytes:
    """The text's words of letters, lower-cased, with a blank before and after each; empty if there is none."""
    text = NOT_LETTERS.sub(" ", (raw or b"").decode("utf-8", "replace").lower()).strip()
    return f" {text} ".encode() if text else b""


def gram_codes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: hashed codes of the n-grams that lie within one text, and each text's first one (one more at the end)."""
    wide = data.astype(np.uint64)
    code = wide.copy()
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] * np.uint64(256) + wide[n - 1 :] if len(code) > 1 else code[:0]
        if n not in GRAMS:
            continue
        hashed = (mix(code + np.uint64(n << 40)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        many = np.maximum(np.diff(offsets) - n + 1, 0)
        first = np.concatenate(([0], np.cumsum(many)))
        at = np.arange(first[-1]) + np.repeat(offsets[:-1] - first[:-1], many)
        yield hashed[at], first


#: families; languages: of each family; pairs: that machines tell apart, after one machine a family (none for one
#: family); weights: a row for each feature and a last one for the constant, a column for each machine.
#: A plain dict, as broadcast values are read before this module can be.
Model = dict


def vectors(texts: list[bytes]) -> np.ndarray:
    x = np.zeros((len(texts), (1 << HASH_BITS) + 1), np.float32)
    for i, raw in enumerate(texts):
        data = np.frombuffer(letters(raw), np.uint8)
        total = 0
        for code, _ in gram_codes(data, np.array([0, len(data)])):
            x[i, :-1] += np.bincount(code, minlength=1 << HASH_BITS)
            total += len(code)
        x[i] /= max(total, 1)
    return x


def fit(texts: list[bytes], labels: list[str]) -> Model:
    """Machines from labelled texts that have letters; none without a text."""
    if not texts:
        return {"families": [], "languages": {}, "pairs": [], "weights": np.zeros((0, 0), np.float32)}
    x, y = vectors(texts), np.array(labels, object)
    # Features count by how much they vary over the sample; the constant is last.
    scale = 1 / (x.std(axis=0) + 1e-4)
    scale /= np.sqrt(len(scale))
    x *= scale.astype(np.float32)
    scale[-1] = 1.0
    x[:, -1] = 1.0
    languages: dict[str, list[str]] = {}
    for code in sorted(set(labels)):
        languages.setdefault(FAMILY_OF.get(code, f"={code}"), []).append(code)
    families, own = sorted(languages), np.array([FAMILY_OF.get(c, f"={c}") for c in labels], object)
    machines = [svm.fit(x, np.where(own == f, 1, -1)) for f in families] if len(families) > 1 else []
    pairs = [p for f in families for p in combinations(languages[f], 2)]
    for a, b in pairs:
        rows = (y == a) | (y == b)
        machines.append(svm.fit(x[rows], np.where(y[rows] == a, 1, -1)))
    table = np.stack(machines, axis=1) * scale[:, None] if machines else np.zeros((len(scale), 0))
    return {"families": families, "languages": languages, "pairs": pairs, "weights": table.astype(np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(2 * x, -30, 30)))


def decide(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Languages and scores from the machines' margins, a row for each text."""
    n, f = len(margins), len(model["families"]) if len(model["families"]) > 1 else 0
    family = margins[:, :f].argmax(axis=1) if f else np.zeros(n, np.int64)
    score = _sigmoid(margins[np.arange(n), family]) if f else np.ones(n)
    out = np.empty(n, object)
    for k, name in enumerate(model["families"]):
        rows, codes = np.flatnonzero(family == k), model["languages"][name]
        votes, sure = np.zeros((len(rows), len(codes))), np.zeros((len(rows), len(codes)))
        for j, (a, b) in enumerate(model["pairs"]):
            if a in codes:
                m = margins[rows, f + j]
                for code, side in ((a, m), (b, -m)):
                    votes[:, codes.index(code)] += side > 0
                    sure[:, codes.index(code)] += side
        # Most votes; of as many, the larger sum of margins.
        best = np.lexsort((sure, votes), axis=1)[:, -1]
        out[rows] = np.array(codes, object)[best]
        if len(codes) > 1:
            score[rows] *= _sigmoid(sure[np.arange(len(rows)), best] / (len(codes) - 1))
    return out, score


def predict(model: Model, texts: list[bytes]) -> tuple[list[str], list[float]]:
    """Language and score of each text; UNKNOWN and 0 without letters."""
    plain = [letters(x) for x in texts]
    names, scores = [UNKNOWN] * len(plain), [0.0] * len(plain)
    has = [i for i, x in enumerate(plain) if x]
    i = 0
    while i < len(has):
        j, size = i, 0
        while j < len(has) and (j == i or size + len(plain[has[j]]) <= STEP_BYTES):
            size += len(plain[has[j]])
            j += 1
        part = [plain[k] for k in has[i:j]]
        data = np.frombuffer(b"".join(part), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in part])))
        total, count = np.zeros((len(part), model["weights"].shape[1])), np.zeros(len(part))
        for code, first in gram_codes(data, offsets):
            for m in range(model["weights"].shape[1]):
                running = np.concatenate(([0.0], np.cumsum(model["weights"][code, m], dtype=np.float64)))
                total[:, m] += running[first[1:]] - running[first[:-1]]
            count += np.diff(first)
        margins = total / np.maximum(count, 1)[:, None] + model["weights"][-1]
        for k, name, s in zip(has[i:j], *decide(model, margins)):
            names[k], scores[k] = name, float(s)
        i = j
    return names, scores


def fit_sample(docs: DataFrame, held_out: int = 5, rows: int = FIT_ROWS, each: int = FIT_ROWS_EACH) -> Model:
    """A model from about `rows` rows with text and lang at most, of those not held out; the same for any partitions."""
    own = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), held_out) != 0))
    sizes = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    quota = min(each, max(1, rows // max(len(sizes), 1)))
    got = [(t, c) for t, c in fit_rows(own, "lang", dict.fromkeys(sizes, quota), sizes, FIT_BYTES) if letters(t)]
    return fit([t for t, _ in got], [c for _, c in got])


def identify(docs: DataFrame, model: Model | None = None, held_out: int = 5) -> DataFrame:
    """docs with lang_pred and score, a row for each row; all columns of docs are kept, these two replaced.

    docs has doc_id and text, and lang for fitting where no model is given; rows with crc32(doc_id) divisible by
    `held_out` are never fitted on.  Null text, empty text and text without letters: `und`, score 0.  Without any
    labelled row all predictions are `und`.  Repeated rows are predicted alike; an empty table gives an empty result.
    """
    docs = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(model or fit_sample(docs, held_out))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary()).to_pylist()
            names, scores = predict(held.value, texts) if held.value["families"] else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return map_arrow(docs, run, schema)
