import duckdb
import pytest
from test_native_operators import base_spans, leaks
from test_simhash import brute

import corpus_pipeline
from kinweave.llm import mixing
from kinweave.llm.queries import ORACLE_SQL, PARTS, PARTS_SQL, QUERIES


@pytest.fixture(scope="module")
def corpus(spark, docs, prose, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    item, base = prose(900, 25), prose(901, 100)
    words = base.split()
    rows = [(i, prose(i, 30 + i % 50), "en" if i % 7 else None, "hot" if i % 3 == 0 else f"s{i % 4}", 1) for i in range(90)]
    rows += [(200 + i, base, "en", "hot", 1) for i in range(6)] + [(300 + i, " ".join(words[: 9 * i] + [f"n{i}"] + words[9 * i :]), "en", "s1", 1) for i in range(8)]
    rows += [(400, f"{prose(5000, 20)} {item} {prose(5001, 20)}", "en", "s1", 1), (401, f"{prose(5002, 30)} mail a.b@c.de or +1 (234) 567-8901 {prose(5003, 9)}", "en", "s2", 1)]
    rows += [(500, None, "en", "s1", 0), (501, "", "en", "s1", 0), (502, "12 34 !", "en", "s1", 0), (600, prose(77, 6000), None, None, 1), (700, prose(78, 40), "en", "s1", 1), (700, prose(78, 40), "en", "s1", 1)]
    docs(rows).write.parquet(f"{root}/documents.parquet")
    items = [(1, item), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows, items


def expected(rows, items):
    """doc_id -> text before mixing, stage by stage and without Spark."""
    left = {i: t for i, t, *_ in rows if any(c.isalpha() for c in t or "")}
    left = {i: left[i] for i, _, c in brute(sorted(left.items())) if i == c}
    left = {r[0]: left[r[0]] for r in leaks(sorted(left.items()), items) if not r[5]}
    out = {}
    for i, text in left.items():
        done, at = [], 0
        for s, e, k in sorted((s, e, k) for k, s, e in base_spans(text)):
            if s >= at:
                done.append(text[at:s] + f"[{k.upper()}]")
            at = max(at, e)
        out[i] = "".join(done) + text[at:]
    return out


def test_pipeline_matches_the_stages_done_plainly(spark, corpus):
    root, rows, items = corpus
    got = corpus_pipeline.run(spark, root).select("doc_id", "text", "source", "n_chars", "epoch", "block", "place").toPandas()
    want = expected(rows, items)
    assert set(got["doc_id"]) <= set(want) and 400 not in want and 401 in want and "[EMAIL]" in want[401]
    assert {i: t for i, t in zip(got["doc_id"], got["text"])} == {i: want[i] for i in set(got["doc_id"])}
    assert all(n == len(t) for n, t in zip(got["n_chars"], got["text"]))
    con = duckdb.connect()
    source = {i: s for i, _, _, s, _ in rows}
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, source[i]) for i, t in want.items()])
    mixed = con.sql(mixing.SQL).df()
    key = ["doc_id", "epoch", "block", "place"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, mixed[key].values.tolist()))


def test_stages_keep_the_columns_of_documents(spark, corpus):
    root, _, _ = corpus
    frame = spark.read.parquet(f"{root}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, root).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_near_duplicates_with_null_and_clashing_ids(spark, docs, prose):
    a, b, c, d, e = (prose(i, 80) for i in range(40, 45))
    rows = [(None, a), (None, b), (None, b), (None, c), (1, c), (5, d), (5, e), (5, e), (7, a), (2, prose(50, 80)), (9, d), (9, prose(51, 80))]
    want = [(1, c), (2, prose(50, 80)), (5, d), (5, e), (7, a), (9, prose(51, 80)), (None, b)]
    for frame in (docs(rows), docs(rows[::-1]).repartition(3)):
        got = corpus_pipeline.near_duplicates(spark, frame, "").collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)


def test_pipeline_on_an_empty_table(spark, docs, corpus, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", list(PARTS))
def test_parts_agree_with_their_sql(spark, corpus, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{corpus[0]}/documents.parquet/*.parquet'")
    want = con.sql(PARTS_SQL[name])
    got = PARTS[name](spark, corpus[0]).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
