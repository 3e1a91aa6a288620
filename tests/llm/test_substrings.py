import hashlib

import pytest

from kinweave.llm import common, substrings


def brute(rows, size=20):
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - size + 1):
            key = tuple(words[s : s + size])
            if first.setdefault(key, (i, s)) != (i, s):
                gone[s : s + size] = [True] * size
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def run(frame):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(frame).collect()}


def test_matches_brute_force(docs, prose, monkeypatch):
    passage = prose(1, 60)
    rows = [(i, f"{prose(i + 50, 30)} {passage} {prose(i + 90, 25)}") for i in range(30)]
    rows += [(100 + i, prose(5, 200)) for i in range(6)]  # exact copies
    rows += [(200, "a " * 300), (201, "a b " * 100)]  # repeats within a document
    rows += [(300, None), (301, ""), (302, " \t\n "), (303, "x " * 19), (304, "x " * 20), (305, prose(9, 20_000)), (306, "é ñ " * 30)]
    want = brute(rows)
    assert run(docs(rows)) == want
    assert run(docs(rows[::-1]).repartition(7)) == want


def test_small_steps_and_blocks_change_nothing(docs, prose, monkeypatch):
    rows = [(i, prose(i % 9, 150) + " " + prose(i, 20)) for i in range(40)]
    monkeypatch.setattr(substrings, "STEP_BYTES", 700)
    monkeypatch.setattr(substrings, "BLOCK_WINDOWS", 50)
    monkeypatch.setattr(substrings, "SKETCH_ANCHORS", 40)
    assert run(docs(rows)) == brute(rows)
    monkeypatch.setattr(substrings, "HELD_BYTES", 300)
    assert run(docs(rows)) == brute(rows)


def test_shuffles_get_partitions_by_size(spark, docs, monkeypatch):
    frame = docs([(1, "a b")])
    assert "REPARTITION_BY_NUM" not in str(common.spread(frame, 0, "doc_id")._jdf.queryExecution().optimizedPlan())
    assert common.spread(frame, 100 * common.PART_BYTES, "doc_id").rdd.getNumPartitions() == 100


def test_a_full_sketch_only_costs_time(docs, prose, monkeypatch):
    rows = [(i, prose(i % 5, 80)) for i in range(20)]
    monkeypatch.setattr(substrings, "repeated", lambda bits, anchor, power: anchor == anchor)
    assert run(docs(rows)) == brute(rows)


def test_rows_of_one_document_do_not_remove_each_other(docs, prose):
    text = prose(2, 50)
    assert [r["n_removed"] for r in substrings.remove_repeats(docs([(1, text), (1, text)])).collect()] == [0, 0]


def test_empty_table_and_other_columns(docs):
    assert run(docs([])) == {}
    frame = docs([(1, "a b", None, None, None)]).selectExpr("*", "1 AS bucket", "2 AS n_words", "'x' AS packed")
    assert run(frame) == {1: (2, 0, hashlib.sha256(b"a b").hexdigest())}


@pytest.mark.parametrize("size", [2, 7])
def test_other_window_sizes(docs, prose, size):
    rows = [(i, prose(i % 3, 30)) for i in range(8)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(docs(rows), size).collect()}
    assert got == brute(rows, size)
