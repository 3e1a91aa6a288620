"""SimHash fingerprints and their self-join over binary tries.

Five bit blocks of a 64-bit fingerprint: two fingerprints with at most three differing bits agree on
two blocks at least.  So each of the ten pairs of blocks gives one rotation of the trie that has those
blocks on top, and all close pairs meet below one top node of some rotation.  Below it, node pairs are
traversed together, bit by bit; a pair is dropped when its differing bits exceed the budget.  Each top
node yields a spanning forest of its links, never all pairs.

A top node with more than NODE_ROWS fingerprints is descended into: the bits not yet agreed on are cut into four, and
two fingerprints with at most three differing bits agree on one of the four.  So the node becomes four rotations
of the tries below it, each with that block on top too, and their nodes are descended into again while they are too
large, DEPTH times at most: then 18 bits are left at most, and no node can have more than 2**18 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, raw_texts, spread
from .components import components

BITS, BUDGET, SEED = 64, 3, 42
#: Fingerprints of one top node that are joined without descending, and how often nodes are descended into.
NODE_ROWS, DEPTH = 2_048, 3
#: Node pairs that a traversal step expands at once (200 bytes each while it does), and links that are held before they
#: become a forest.
FRONTIER, HELD_LINKS = 1 << 17, 1 << 19
CUTS = (0, 13, 26, 39, 52, 64)
_M64 = (1 << 64) - 1
_SPAN = [((1 << (b - a)) - 1) << (64 - b) for a, b in zip(CUTS, CUTS[1:])]
#: The bits of each rotation's top blocks.
TOPS = [_SPAN[a] | _SPAN[b] for a, b in combinations(range(5), 2)]


def below(mask: int) -> list[int]:
    """mask with each quarter of the bits that it lacks, highest bits first."""
    free = [b for b in reversed(range(BITS)) if not mask >> b & 1]
    cut = [len(free) * i // 4 for i in range(5)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cut, cut[1:])]


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle of one text, repeats included."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate(([0], np.cumsum(size)))
    h = xxhash.xxh64_intdigest
    spans = zip(start[: -k].tolist(), (start[k:] - 1).tolist())
    return np.fromiter((h(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if more than half of the hashes have it; no hash: zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp long) for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(x, k)) for x in raw_texts(batch.column(1))], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


# --- the trie join of one task: arrays of nodes, each a range of sorted keys ---


def trie_links(keys: np.ndarray, roots: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a spanning forest of the links between keys under the same root.

    keys: uint64, sorted within each root; roots: sorted ids.  A node is a range [lo, hi) of keys with
    equal leading bits.  All node pairs of a depth are expanded together; a pair whose differing bits exceed the
    budget is not expanded.  Links become a forest whenever HELD_LINKS of them have been found.
    """
    n = len(keys)
    first = np.flatnonzero(np.concatenate(([True], roots[1:] != roots[:-1])))
    last = np.append(first[1:], n)
    big = last - first > 1
    stack = [(0, first[big], last[big], first[big], last[big], np.zeros(big.sum(), np.int64))]
    linked: list[tuple[np.ndarray, np.ndarray]] = []
    while stack:
        depth, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > FRONTIER:
            h = len(alo) // 2
            stack += [(depth, *(x[h:] for x in (alo, ahi, blo, bhi, diff))), (depth, *(x[:h] for x in (alo, ahi, blo, bhi, diff)))]
            continue
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            a, b = alo[leaf], blo[leaf]
            near = (a < b) & (np.bitwise_count(keys[a] ^ keys[b]) <= budget)
            linked.append((a[near], b[near]))
            if sum(len(x) for x, _ in linked) > HELD_LINKS:
                linked = [_forest(n, np.concatenate([x for x, _ in linked]), np.concatenate([x for _, x in linked]))]
            rest = ~leaf
            alo, ahi, blo, bhi, diff = (x[rest] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo) or depth == BITS:
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        amid, bmid = _split(keys, alo, ahi, bit), _split(keys, blo, bhi, bit)
        same = (alo == blo) & (ahi == bhi)
        more = diff < budget
        parts = [(alo, amid, blo, bmid, diff), (amid, ahi, bmid, bhi, diff), tuple(x[more] for x in (alo, amid, bmid, bhi, diff + 1))]
        other = more & ~same  # a node paired with itself: its two children meet once
        parts.append(tuple(x[other] for x in (amid, ahi, blo, bmid, diff + 1)))
        got = [np.concatenate(x) for x in zip(*parts)]
        keep = (got[0] < got[1]) & (got[2] < got[3]) & ~((got[0] == got[2]) & (got[1] - got[0] == 1))
        stack.append((depth + 1, *(x[keep] for x in got)))
    if not linked:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(n, np.concatenate([x for x, _ in linked]), np.concatenate([x for _, x in linked]))


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where the given bit turns to one in each range; binary search in all ranges at once."""
    a, b = lo.copy(), hi.copy()
    while True:
        open_ = a < b
        if not open_.any():
            return a
        mid = (a + b) >> 1
        one = (keys[np.minimum(mid, len(keys) - 1)] & bit) != 0
        b = np.where(open_ & one, mid, b)
        a = np.where(open_ & ~one, mid + 1, a)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (member, least member) with the same components as the links."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    own = np.flatnonzero(root != np.arange(n))
    return own, root[own]


def _join_sorted(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows (rot, top, fp) sorted by all three -> links (u, v) of fingerprints."""
    held: list[np.ndarray] = []
    rows = 0

    def flush(x: np.ndarray) -> pa.RecordBatch:
        fresh = np.concatenate(([True], (x[:2, 1:] != x[:2, :-1]).any(axis=0)))
        fp = x[2].view(np.uint64)
        root = np.cumsum(fresh)
        order = np.lexsort((fp, root))  # unsigned order within a root
        a, b = trie_links(fp[order], root, budget)
        out = x[2][order]
        return pa.record_batch([pa.array(out[a]), pa.array(out[b])], names=["u", "v"])

    for batch in batches:
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        held.append(x)
        rows += x.shape[1]
        if rows >= 1 << 17:
            x = np.concatenate(held, axis=1)
            fresh = np.flatnonzero((x[:2, 1:] != x[:2, :-1]).any(axis=0)) + 1
            cut = fresh[-1] if len(fresh) else 0
            if cut:
                yield flush(x[:, :cut])
            held = [x[:, cut:]]
            rows = x.shape[1] - cut
    if held and rows:
        yield flush(np.concatenate(held, axis=1))


def nodes(fps: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """(rot, top, fp): the fingerprints of every node to be joined; rot numbers the bits that top has.

    A fingerprint has ten rows, or four more for each of its nodes that is descended into.
    """
    masks, out = TOPS, None
    under = lambda m: F.struct(F.lit(m[0]).alias("rot"), F.col("fp").bitwiseAND(F.lit(_signed(m[1]))).alias("top"))
    rows = fps.select("fp", F.explode(F.array(*map(under, enumerate(masks)))).alias("x")).select("x.rot", "x.top", "fp")
    for depth in range(DEPTH + 1):
        size = materialise(rows.groupBy("rot", "top").agg(F.count("*").alias("n")).where("n > 1"))
        hot = size.where(F.col("n") > node_rows)
        last = depth == DEPTH or hot.isEmpty()
        ready = rows.join(size if last else size.where(F.col("n") <= node_rows), ["rot", "top"], "left_semi").select("rot", "top", "fp")
        out = ready if out is None else out.unionByName(ready)
        if last:
            return out
        # A hot node's rows go on under each quarter of their free bits; numbers of rotations grow fourfold by depth.
        quarters = [below(m) for m in masks]
        first = sum(10 * 4**d for d in range(depth + 1))
        within = F.array(*[F.array(*[F.lit(_signed(q)) for q in four]) for four in quarters])
        base = F.col("rot") - F.lit(first - len(masks))
        inner = F.transform(F.get(within, base), lambda m, i: F.struct((F.lit(first) + base * 4 + i).alias("rot"), F.col("fp").bitwiseAND(m).alias("top")))
        rows = materialise(rows.join(hot, ["rot", "top"], "left_semi").select("fp", F.explode(inner).alias("x")).select("x.rot", "x.top", "fp"))
        masks = [q for four in quarters for q in four]
    raise AssertionError("unreachable")


def links(fps: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """Distinct fingerprints (fp long) -> links (u, v) that connect what lies within `budget` bits.

    budget is 3 at most: five blocks then leave two that agree, and four blocks one.
    """
    if not 0 <= budget <= 3:
        raise ValueError("five blocks serve a budget of 0 to 3 bits")
    dealt = spread(nodes(fps, node_rows), 10 * 20 * fps.count(), "rot", "top").sortWithinPartitions("rot", "top", "fp")
    return map_arrow(dealt, lambda it: _join_sorted(it, budget), "u long, v long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_groups(docs: DataFrame, k: int = 3, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs(doc_id, text).

    Null text or text without words: fingerprint zero, linked like any other.  Fewer than k words:
    their whole sequence is the one shingle.  component_id is the smallest doc_id reachable over
    fingerprints that differ in at most `budget` bits, itself included.  Repeated rows give repeated rows;
    other columns are ignored; an empty table gives an empty result.
    """
    out = near_roots(docs, k, budget)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_roots(docs: DataFrame, k: int = 3, budget: int = BUDGET) -> DataFrame:
    """near_groups() with the fingerprint as a number, fp, and root, which tells components apart whatever their ids are."""
    fp = materialise(fingerprints(docs, k))
    groups = materialise(fp.groupBy("fp").agg(F.min("doc_id").alias("low")))
    near = components(links(groups.select("fp"), budget)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    # A component's fingerprints carry the least doc_id of all of them.
    member = groups.join(near, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("low").alias("component_id"))
    named = member.join(least, "root").select("fp", "root", "component_id")
    return fp.join(named, "fp").select("doc_id", "fp", "root", "component_id")
