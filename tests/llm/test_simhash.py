from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import components, simhash


def classes(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    ids = [i for i, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: ids[k])
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if bin(fps[order[a]] ^ fps[order[b]]).count("1") <= 3]
    root = classes(len(rows), pairs)
    return sorted((ids[order[k]], f"{fps[order[k]]:016x}", ids[order[root[k]]]) for k in range(len(rows)))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_trie_links_connect_what_lies_within_three_bits(seed):
    rng = np.random.default_rng(seed)
    keys = rng.integers(0, 1 << 63, 4, dtype=np.uint64)[rng.integers(0, 4, 60)]
    for _ in range(4):
        keys = keys ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))
    keys = np.unique(keys)
    roots = np.sort(rng.integers(0, 2, len(keys)))
    order = np.lexsort((keys, roots))
    keys = keys[order]
    a, b = simhash.trie_links(keys, roots, 3)
    near = [(i, j) for i in range(len(keys)) for j in range(i) if roots[i] == roots[j] and bin(int(keys[i] ^ keys[j])).count("1") <= 3]
    assert classes(len(keys), near) == classes(len(keys), list(zip(a.tolist(), b.tolist())))


def test_groups_match_brute_force(docs, prose):
    base = prose(1, 120)
    words = base.split()
    rows = [(i, prose(i + 10, 40 + i)) for i in range(40)]
    rows += [(100 + i, " ".join(words[:i] + ["x"] + words[i + 1 :])) for i in range(0, 120, 4)]  # near copies
    rows += [(200 + i, base) for i in range(30)]  # exact copies
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "ONE"), (305, "two words"), (306, prose(7, 5000))]
    got = simhash.near_groups(docs(rows)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_hot_nodes_are_split_without_losing_links(spark, docs, prose):
    words = prose(3, 400).split()
    rows = [(i, " ".join(words[: i % 400] + [f"q{i}"] + words[i % 400 :])) for i in range(300)]
    fps = simhash.fingerprints(docs(rows)).select("fp").distinct()
    whole = sorted(map(tuple, components.components(simhash.links(fps)).collect()))
    split = sorted(map(tuple, components.components(simhash.links(fps, node_rows=16)).collect()))
    assert whole == split and whole


def test_a_dense_top_node_is_descended_into(spark):
    rng = np.random.default_rng(7)
    # 20,000 fingerprints that share 40 bits, and so a top node of each rotation: half in a cluster of a dozen free bits.
    free = np.concatenate([rng.integers(0, 1 << 24, 16_000), rng.integers(0, 1 << 12, 4_000) << 12])
    keys = np.unique(free.astype(np.uint64) | np.uint64(0xABCDE12345 << 24))
    frame = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long")
    placed = simhash.nodes(frame)
    assert placed.count() < 50 * len(keys)
    got = dict(map(tuple, components.components(simhash.links(frame)).collect()))
    at = {int(k): i for i, k in enumerate(keys)}
    flips = [sum(1 << b for b in c) for r in (1, 2, 3) for c in combinations(range(24), r)]
    pairs = [(i, at[o]) for i, k in enumerate(keys.tolist()) for f in flips if (o := k ^ f) in at and o < k]
    signed = keys.view(np.int64)
    want = classes(len(keys), pairs)
    groups = {}
    for i, root in enumerate(want):
        groups.setdefault(root, []).append(int(signed[i]))
    assert got == {k: min(g) for g in groups.values() if len(g) > 1 for k in g}


def test_quarters_cover_the_free_bits_once():
    for mask in simhash.TOPS:
        for _ in range(simhash.DEPTH):
            four = simhash.below(mask)
            assert sum(q & ~mask for q in four) == ((1 << 64) - 1) & ~mask and all(q & mask == mask for q in four)
            mask = min(four, key=int.bit_count)
        assert 64 - mask.bit_count() <= 18


def test_empty_table_repeated_rows_and_other_columns(spark, docs):
    assert simhash.near_groups(docs([])).collect() == []
    twice = docs([(5, "a b c d", None, None, None), (5, "a b c d", None, None, None)]).selectExpr("*", "1 AS fp", "2 AS component_id")
    assert [r["component_id"] for r in simhash.near_groups(twice).collect()] == [5, 5]


def test_budget_beyond_three_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), budget=4)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300))
