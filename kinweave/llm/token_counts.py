"""Token counts by a two-tier lookup on the map side.

Tier 1 is a broadcast table of the token lengths of frequent pieces, tier 2 a bounded cache in
each Python worker that asks the tokenizer library on a miss.  No piece is ever shuffled.  The
table is fitted on a bounded sample and only saves time: every length comes from the library.

A piece is what stands between two single blanks, with the blank before it.  The byte-level
pre-tokenizer never joins characters across such a blank, except in runs of white space that go on
after a blank; texts with such a run are encoded whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, raw_texts

#: White space, a blank, then more white space or the end: pieces would not be independent.
ODD = re.compile(r"\s (?:\s|$)")
SCHEMA = "n_bytes long, n_tokens long"
#: Rows in the sample for tier 1, its entries, and a worker's cache entries.
SAMPLE_ROWS, TABLE_ENTRIES, CACHE_ENTRIES = 1_000, 30_000, 300_000
#: Longer pieces are not cached, so that the cache is bounded in bytes too.
CACHED_CHARS = 64

_worker: dict = {}


def tokenizer(path: str):
    from tokenizers import Tokenizer

    if path not in _worker:
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _worker[path] = t
    return _worker[path]


def pieces(text: str) -> list[str]:
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


class Counting:
    """Token counts of texts, through the two tiers.  special: strings the library treats as one token."""

    def __init__(self, path: str, frequent: dict[str, int], special: list[str], cache: int = CACHE_ENTRIES):
        self.library, self.frequent, self.limit = tokenizer(path), frequent, cache
        self.special, self.cache = special, {}

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if ODD.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        total, frequent, cache = 0, self.frequent, self.cache
        for piece in pieces(text):
            n = frequent.get(piece)
            if n is None:
                n = cache.get(piece)
                if n is None:
                    n = self.whole(piece) if piece else 0
                    if len(piece) <= CACHED_CHARS:
                        if len(cache) >= self.limit:
                            cache.clear()
                        cache[piece] = n
            total += n
        return total


def fit_table(docs: DataFrame, path: str, rows: int = SAMPLE_ROWS, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """Lengths of the most frequent pieces among at most `rows` texts of at most 20,000 characters."""
    sample = docs.where(F.length("text") <= 20_000).select("text").limit(rows).toLocalIterator()
    seen: Counter = Counter()
    for (text,) in sample:
        if not ODD.search(text):
            seen.update(x for x in pieces(text) if len(x) <= CACHED_CHARS)
    library = tokenizer(path)
    top = [x for x, _ in seen.most_common(entries) if x]
    found = library.encode_batch(top, add_special_tokens=False) if top else []
    return {x: len(e.ids) for x, e in zip(top, found)}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs(doc_id, text).

    Null or empty text: 0 bytes, 0 tokens.  Repeated rows are counted once each; other columns of
    docs are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    special = [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]
    held = spark.sparkContext.broadcast((path, fit_table(docs, path), special))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counting(*held.value)
        for batch in batches:
            raw = raw_texts(batch.column(1))
            yield pa.record_batch(
                [batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([count(x.decode("utf-8", "replace")) for x in raw], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    out = map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
