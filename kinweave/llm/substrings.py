"""Removal of word windows that also start earlier in the corpus.

Pass 1 builds a count-min sketch: every map task adds up its own partition's sketch, and the partition
sketches are merged segment by segment.  What is counted is each window's anchor, the ten-word run with
the least hash in it: equal windows have equal anchors at the same place, so an anchor's count is never
below the count of a window with it, and the sketch never estimates too little.  No repeated window is lost.

Pass 2 groups exactly the windows whose estimate is two or more, by 96-bit hashes, and marks all but the
first of each.  A block of texts sends only its own first occurrence of a window; later ones in the block are
known to be repeats at once.  So a passage in very many texts costs one entry a block, and the task that gets
them all keeps the first of each window only, whenever HELD_BYTES have come in.

Entries travel packed: a row is all that one block has for one shard.

The merged sketch has a fixed size, as it is broadcast.  It spares pass 2 most windows up to some tens of gigabytes of
text; with more, its cells fill up and all windows travel: 12 bytes a word, and the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PART_BYTES, blocks, buffers, map_arrow, raw_texts, spread
from .wordhash import SPAN_BASES, prefix_hash, word_hashes

#: Cells of a sketch row are a power of two; this many powers at least and at most.  Two rows of bits are
#: broadcast: 2 * 2**28 / 8 = 64 MB at most.  A fuller sketch only lets more windows into pass 2.
LEAST_POWER, MOST_POWER, SEGMENT = 20, 28, 20
ROWS = 2
#: Bytes of text to a shard, and the least number of shards.
SHARD_BYTES, LEAST_SHARDS = 8 << 20, 64
#: Bytes of text hashed at once, candidate windows to a block, anchors to a partition sketch.
STEP_BYTES, BLOCK_WINDOWS, SKETCH_ANCHORS = 1 << 19, 1 << 19, 1 << 20
#: Bytes of a shard's entries that are held before repeats among them are sent on.
HELD_BYTES = 32 << 20
RUN = np.dtype([("doc", "<i8"), ("start", "<i4"), ("n", "<i4"), ("bucket", "<i4")])
WINDOW = np.dtype([("h", "<u8"), ("g", "<u4")])


def anchors(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, each one's text, and the hash and place of each one's anchor (leftmost of the least)."""
    n = np.diff(first)
    many = np.maximum(n - size + 1, 0)
    text = np.repeat(np.arange(len(n)), many)
    start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[:-1], many)
    if not len(start):
        return start, text, h[:0], start
    k = size // 2
    span = prefix_hash(h, SPAN_BASES[0])
    at = np.arange(len(h) - k + 1)
    gram = span(at, at + k)
    least, place = gram[start], start.copy()
    for j in range(1, size - k + 1):
        other = gram[start + j]
        less = other < least
        least[less] = other[less]
        place[less] = start[less] + j
    return start, text, least, place


def cells(anchor: np.ndarray, power: int) -> list[np.ndarray]:
    """The anchor's cell in each sketch row."""
    shift = np.uint64(64 - power)
    return [(anchor * np.uint64(m)) >> shift for m in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)]


def word_blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, word hashes, first words) of groups of texts with about STEP_BYTES bytes."""
    data, offsets = buffers(batch.column(column))
    for i, j in blocks(offsets, STEP_BYTES):
        yield slice(i, j), *word_hashes(data, offsets[i : j + 1])


def _sketch(batches: Iterator[pa.RecordBatch], size: int, power: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    low = np.uint64((1 << SEGMENT) - 1)

    def flush() -> Iterator[pa.RecordBatch]:
        for row, cell in enumerate(cells(np.concatenate(held), power)):
            cell, times = np.unique(cell, return_counts=True)
            code = (((cell & low) << np.uint64(1)) | (times > 1).astype(np.uint64)).astype("<u4")
            segment = (cell >> np.uint64(SEGMENT)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
            name = segment[cut] + (row << (power - SEGMENT))
            yield pa.record_batch([pa.array(name), pa.array([x.tobytes() for x in np.split(code, cut[1:])], pa.binary())], names=["segment", "packed"])

    for batch in batches:
        for _, h, first in word_blocks(batch, 0):
            _, text, anchor, place = anchors(h, first, size)
            if len(place):
                held.append(anchor[np.concatenate(([True], place[1:] != place[:-1]))])
            if sum(map(len, held)) >= SKETCH_ANCHORS:
                yield from flush()
                held = []
    if held:
        yield from flush()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by segment -> (segment, bits of the cells that count two or more)."""
    now, count = None, np.zeros(1 << SEGMENT, np.uint8)

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([now], pa.int64()), pa.array([np.packbits(count > 1).tobytes()], pa.binary())], names=["segment", "bits"])

    for batch in batches:
        for segment, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if segment != now:
                if now is not None:
                    yield out()
                now = segment
                count[:] = 0
            code = np.frombuffer(packed, "<u4")
            at = code >> 1
            count[at] = np.minimum(2, count[at] + 1 + (code & 1).astype(np.uint8))
    if now is not None:
        yield out()


def sketch(docs: DataFrame, size: int, power: int, total: int) -> np.ndarray:
    """Bits of the merged sketch, row after row: set where a cell counts two or more."""
    parts = map_arrow(docs.select("text"), lambda it: _sketch(it, size, power), "segment long, packed binary")
    # Partition sketches have some 8 bytes for each anchor; a task takes one segment at least.
    dealt = spread(parts, min((ROWS << power) // (1 << SEGMENT) * PART_BYTES, total // 4), "segment")
    merged = map_arrow(dealt.sortWithinPartitions("segment"), _merge, "segment long, bits binary")
    bits = np.zeros((ROWS << power) // 8, np.uint8)
    width = (1 << SEGMENT) // 8
    for segment, packed in merged.toLocalIterator():
        bits[segment * width : (segment + 1) * width] = np.frombuffer(packed, np.uint8)
    return bits


def repeated(bits: np.ndarray, anchor: np.ndarray, power: int) -> np.ndarray:
    found = np.ones(len(anchor), bool)
    for row, cell in enumerate(cells(anchor, power)):
        cell = cell.astype(np.int64) + (row << power)
        found &= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return found


def to_runs(doc: np.ndarray, start: np.ndarray, bucket: np.ndarray, apart: np.ndarray | None = None) -> np.ndarray:
    """Runs of consecutive starts; the input is in order of (doc, start).  apart: where a run must begin."""
    if not len(doc):
        return np.zeros(0, RUN)
    fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)))
    if apart is not None:
        fresh |= apart
    at = np.flatnonzero(fresh)
    run = np.zeros(len(at), RUN)
    run["doc"], run["start"], run["bucket"], run["n"] = doc[at], start[at], bucket[at], np.diff(np.append(at, len(doc)))
    return run


def _deal(kind: int, key: np.ndarray, *parts: np.ndarray) -> pa.RecordBatch:
    """A row for each key: (kind, key, packed), where packed holds what each part has for it; key: of each part's items."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    packed = [x.tobytes() for x in np.split(parts[0][order], cut[1:])] if len(key) else []
    return pa.record_batch([pa.array(np.full(len(cut), kind), pa.int32()), pa.array(key[cut].astype(np.int64)), pa.array(packed, pa.binary())], names=["kind", "key", "packed"])


def _candidates(batches: Iterator[pa.RecordBatch], size: int, power: int, bits: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """(bucket, doc_id, text) -> kind 0: windows for a shard, kind 1: runs of known repeats for a bucket."""
    held: list[tuple[np.ndarray, ...]] = []
    n = words = 0
    for batch in batches:
        buckets = batch.column(0).to_numpy(zero_copy_only=False)
        docs = batch.column(1).to_numpy(zero_copy_only=False)
        for rows, h, first in word_blocks(batch, 2):
            start, text, anchor, place = anchors(h, first, size)
            found = repeated(bits, anchor, power)
            start, text, anchor, place = start[found], text[found], anchor[found], place[found]
            key = [prefix_hash(h, b)(start, start + size) for b in SPAN_BASES]
            at = (start - first[text]).astype(np.int32)
            held.append((key[0], key[1] >> np.uint64(32), docs[rows][text], at, buckets[rows][text].astype(np.int32), anchor, place + words))
            n, words = n + len(start), words + len(h) + 1
            if n >= BLOCK_WINDOWS:
                yield from _send(held, shards)
                held, n = [], 0
    if n:
        yield from _send(held, shards)


def _send(held: list[tuple[np.ndarray, ...]], shards: int) -> Iterator[pa.RecordBatch]:
    """A block's candidate windows -> its known repeats, and its first occurrences by shard."""
    h, g, doc, at, bucket, anchor, place = (np.concatenate(x) for x in zip(*held))
    later = not_first(h, g, doc, at)
    order = np.lexsort((at[later], doc[later]))
    known = to_runs(*(x[later][order] for x in (doc, at, bucket)))
    yield _deal(1, known["bucket"], known)
    keep = ~later
    window = np.zeros(keep.sum(), WINDOW)
    window["h"], window["g"] = h[keep], g[keep]
    doc, at, bucket, anchor, place = (x[keep] for x in (doc, at, bucket, anchor, place))
    run = to_runs(doc, at, bucket, np.concatenate(([True], place[1:] != place[:-1])))
    begin = np.cumsum(run["n"]) - run["n"]
    shard = (anchor[begin] % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    run, begin, shard = run[order], begin[order], shard[order]
    cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
    packed = []
    for a, b in zip(cut, np.append(cut[1:], len(shard))):
        own = np.repeat(begin[a:b], run["n"][a:b]) + _within(run["n"][a:b])
        packed.append(np.array([b - a], "<i8").tobytes() + run[a:b].tobytes() + window[own].tobytes())
    yield pa.record_batch([pa.array(np.zeros(len(cut)), pa.int32()), pa.array(shard[cut]), pa.array(packed, pa.binary())], names=["kind", "key", "packed"])


def _within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n[0] - 1, 0, 1, ... n[1] - 1, ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def not_first(h: np.ndarray, g: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which windows also start earlier, by (doc, at)."""
    order = np.lexsort((at, doc, g, h))
    h, g, doc, at = h[order], g[order], doc[order], at[order]
    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    out = np.zeros(len(h), bool)
    out[order] = (doc != doc[head]) | (at != at[head])
    return out


def _unpack(held: list[bytes]) -> tuple[np.ndarray, ...]:
    """hash parts, document, place and bucket of each window in packed entries."""
    runs, windows = [], []
    for packed in held:
        k = int(np.frombuffer(packed, "<i8", 1)[0])
        runs.append(np.frombuffer(packed, RUN, k, 8))
        windows.append(np.frombuffer(packed, WINDOW, -1, 8 + k * RUN.itemsize))
    run, window = np.concatenate(runs), np.concatenate(windows)
    doc, bucket = np.repeat(run["doc"], run["n"]), np.repeat(run["bucket"], run["n"])
    return window["h"], window["g"], doc, np.repeat(run["start"], run["n"]) + _within(run["n"]).astype(np.int32), bucket


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, key): a shard's windows -> runs of repeats for buckets; kind 1 passes through."""
    now, held, size, first = None, [], 0, None

    def settle() -> pa.RecordBatch:
        """The repeats among the first windows so far and what is held; the first ones stay."""
        nonlocal first, size
        new = _unpack(held)
        h, g, doc, at, bucket = (np.concatenate(x) for x in zip(first, new)) if first else new
        later = not_first(h, g, doc, at)
        order = np.lexsort((at[later], doc[later]))
        known = to_runs(*(x[later][order] for x in (doc, at, bucket)))
        first = tuple(x[~later] for x in (h, g, doc, at, bucket))
        held.clear()
        size = 0
        return _deal(1, known["bucket"], known)

    for batch in batches:
        through = []
        for kind, key, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if kind:
                through.append((key, packed))
                continue
            if key != now:
                if held:
                    yield settle()
                first = None
            now = key
            held.append(packed)
            size += len(packed)
            if size >= HELD_BYTES:
                yield settle()
        if through:
            yield pa.record_batch([pa.array([1] * len(through), pa.int32()), pa.array([k for k, _ in through], pa.int64()), pa.array([p for _, p in through], pa.binary())], names=["kind", "key", "packed"])
    if held:
        yield settle()


def _apply(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, is_doc): first a bucket's runs, then its texts."""
    now, held, runs = None, [], None
    for batch in batches:
        bucket, is_doc, packed = (batch.column(i).to_pylist() for i in (0, 1, 4))
        texts = raw_texts(batch.column(3))
        rows = []
        for i, doc in enumerate(batch.column(2).to_pylist()):
            if bucket[i] != now:
                now, held, runs = bucket[i], [], None
            if not is_doc[i]:
                held.append(np.frombuffer(packed[i], RUN))
                continue
            if runs is None:
                runs = np.sort(np.concatenate([*held, np.zeros(0, RUN)]), order="doc")
                held = []
            words = texts[i].split()
            a, b = np.searchsorted(runs["doc"], [doc, doc + 1])
            removed = 0
            if b > a:
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, runs["start"][a:b], 1)
                np.add.at(step, runs["start"][a:b] + runs["n"][a:b] + size - 1, -1)
                keep = np.cumsum(step[:-1]) == 0
                removed = len(words) - int(keep.sum())
                kept = b" ".join(compress(words, keep.tolist()))
            else:
                kept = b" ".join(words)
            rows.append((doc, len(words), removed, kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()))
        if rows:
            doc, n, gone, kept, digest = zip(*rows)
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def remove_repeats(docs: DataFrame, size: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256) for each row of docs(doc_id, text).

    A word is removed if a window of `size` words over it also starts earlier: in a smaller doc_id, or in the
    same document further left.  Null text has no words; kept_text is then empty.  Texts shorter than a window
    keep all words.  Rows with the same doc_id are the same document, so they don't remove each other.
    Other columns are ignored; an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long"), "text")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word takes 6 bytes or more as a rule, and an anchor serves 5 or 6 window starts; four cells to an anchor.
    power = min(MOST_POWER, max(LEAST_POWER, int(total / 36 * 4).bit_length()))
    shards = max(LEAST_SHARDS, total // SHARD_BYTES)
    held = own.sparkSession.sparkContext.broadcast(sketch(own, size, power, total))
    own = own.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("bucket"), "doc_id", "text")
    entries = map_arrow(own, lambda it: _candidates(it, size, power, held.value, shards), "kind int, key long, packed binary")
    dealt = spread(entries, total, "kind", "key").sortWithinPartitions("kind", "key")
    runs = map_arrow(dealt, _resolve, "kind int, key long, packed binary")
    none = F.lit(None)
    both = own.select("bucket", F.lit(True).alias("is_doc"), "doc_id", "text", none.cast("binary").alias("packed")).unionByName(
        runs.select(F.col("key").cast("int").alias("bucket"), F.lit(False).alias("is_doc"), none.cast("long").alias("doc_id"), none.cast("string").alias("text"), "packed")
    )
    met = spread(both, 2 * total, "bucket").sortWithinPartitions("bucket", "is_doc")
    return map_arrow(met, lambda it: _apply(it, size), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM later),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
