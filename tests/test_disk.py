"""What linkage writes and moves: texts once, tokens as numbers, pairs in rounds."""

import hashlib
import random
import re
from dataclasses import replace
from pathlib import Path

from pyspark.sql import functions as F

from kinweave.operators import blocking
from kinweave.plans import catalog, checks, fixture
from kinweave.sources import shared


def texts(spark, folder, n=300):
    rng = random.Random(1)
    rows = [(i, " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 200))) or None, "en") for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return sum(len(t or "") for _, t, _ in rows)


def test_records_hold_each_text_once(spark, tmp_path):
    size = texts(spark, tmp_path)
    mark = shared.written()
    recs = fixture.records(spark, str(tmp_path))
    table = shared._written[mark]
    on_disk = sum(f.stat().st_size for f in Path(table.kinweave_path.removeprefix("file:")).rglob("*.parquet"))
    assert recs.count() == 300 and on_disk < size  # 3.1 x a table's input when five fields held the whole text
    shared.sweep(mark)


def test_numbered_tokens_count_as_the_tokens_do(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(1 + i % 3, f"S{1 + i % 3}-{i}", [f"w{int(rng.paretovariate(0.4)) % 2000}" for _ in range(rng.randint(0, 30))]) for i in range(200)] + [(1, "S1-none", None)]
    recs = spark.createDataFrame(rows, "src tinyint, entity_id string, t array<string>").repartition(3)
    stats = blocking.token_df(recs, "t")
    df = {r["token"]: r["df"] for r in stats.collect()}
    monkeypatch.setattr(blocking, "SMALL", 20)
    monkeypatch.setattr(blocking, "BITS", 64)
    sets = blocking.token_sets(recs, "t", blocking.numbered(stats))
    got = {r["entity_id"]: r for r in sets.collect()}
    words = {e: set(t or []) for _, e, t in rows}
    assert any(r["rest"] for r in got.values()) and any(r["small"] for r in got.values())
    for e, t in words.items():
        assert got[e]["n"] == len(t) and got[e]["ranked"] == sorted(t, key=lambda w: (df[w], w))[:2]
    for r in blocking.token_sets(recs, "t", blocking.numbered(stats), "[0-4]$").collect():
        assert r["n"] == len(words[r["entity_id"]]) and r["ranked"] == sorted((w for w in words[r["entity_id"]] if w[-1] > "4"), key=lambda w: (df[w], w))[:2]
    monkeypatch.setattr(blocking, "ROUND", 100)
    monkeypatch.setattr(blocking, "ROUND_X", 1)
    pairs = recs.where("src = 1").select(F.col("entity_id").alias("s1_id")).crossJoin(recs.where("src > 1").select("src", F.col("entity_id").alias("tgt_id")))
    met = blocking.meet(pairs, sets, blocking.n_shared("a_", "b_").alias("n")).collect()
    assert len(met) == 68 * 133 and all(r["n"] == len(words[r["s1_id"]] & words[r["tgt_id"]]) for r in met)


def test_rounds_of_records_and_addresses_that_go(spark, tmp_path, monkeypatch):
    texts(spark, tmp_path)
    monkeypatch.setattr(blocking, "BITS", 64)
    monkeypatch.setattr(blocking, "SMALL", 0)
    read = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    rec, keys = catalog._keys(spark, str(tmp_path), whole=True, sets=True)
    want = read(keys, *keys.columns), read(rec.kinweave_sets, "entity_id", "n", "ranked"), read(rec, "name_key", "addr_house", "full")
    monkeypatch.setattr(blocking, "SLICE", 40)
    mark = shared.written()
    rec, keys = catalog._keys(spark, str(tmp_path), sets=True)
    assert (read(keys, *keys.columns), read(rec.kinweave_sets, "entity_id", "n", "ranked"), read(rec, "name_key", "addr_house", "full")) == want
    left = [t for t in shared._written[mark:] if Path((t.kinweave_path or "/gone").removeprefix("file:")).exists()]
    assert not any("addr_norm" in t.columns or "rest" in t.columns and "known" in t.columns for t in left)  # whole texts stayed till the end before
    shared.sweep(mark)


def test_packed_grams_give_the_cosines_of_joined_ones(spark, monkeypatch):
    rng = random.Random(3)
    words = ["a", "bc", "a", "déf", "ghij", "xyzzyx", "12", "  ", "\t", "bbbbbbb"]
    rows = [(1 + i % 3, f"S{1 + i % 3}-{i}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(1, "S1-none", None), (2, "S2-lone", "qqqq")]
    recs = spark.createDataFrame(rows, "src tinyint, entity_id string, t string").repartition(3)
    pairs = recs.where("src = 1").select(F.col("entity_id").alias("s1_id")).crossJoin(recs.where("src > 1").select("src", F.col("entity_id").alias("tgt_id")))
    monkeypatch.setattr(blocking, "ROUND", 300)
    monkeypatch.setattr(blocking, "ROUND_X", 0.5)
    read = lambda df: {(r["s1_id"], r["tgt_id"]): round(r["c"], 9) for r in df.collect()}
    for low, high in ((2, 4), (3, 3)):
        want = read(blocking.pair_cosine(pairs, blocking.gram_weights(recs, "t", low, high), "c"))
        assert len(want) == 21 * 41 and any(want.values()) and read(blocking.text_cosine(pairs, recs, "t", low, high, "c")) == want
    monkeypatch.setattr(blocking, "MOST_GRAMS", 5)
    assert read(blocking.text_cosine(pairs, recs, "t", 3, 3, "c")) == want
    assert blocking._codes("x\U0001f600", 3, 3) is None


def test_feature_values_move_no_addresses(spark, tmp_path):
    texts(spark, tmp_path)
    mark = shared.written()
    plan = checks.QUERIES["pair_feature_values"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    # Both sides explode names, twice; addresses were exploded as often, and pairs met counts by whole addresses.
    assert plan.count("Generate explode") == 4 and not [x for x in plan.splitlines() if "Join" in x and "addr_norm" in x]
    shared.sweep(mark)


def test_best_pairs_in_rounds_of_query_records_write_no_other_pairs(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    bases = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(20)]
    rows = [(i, bases[i % 20] + f" x{i % 9}", "en") for i in range(180)]  # groups of copies, whose pairs are many for each record
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    read = lambda df: sorted(map(str, df.collect()))
    rec, keys = catalog._keys(spark, str(tmp_path), sets=True)
    sets, usable = rec.kinweave_sets.drop("ranked"), shared.materialise(blocking.usable_keys(keys, catalog.SETTINGS, 0))
    pairs = catalog._cheap(blocking.meet(blocking.candidate_pairs(keys, usable), sets, *catalog._scores()))
    want = read(blocking.top_pairs(pairs, catalog.SETTINGS))
    assert pairs.count() > len(want) > 100
    n = usable.agg(F.sum(F.col("a") * F.col("b"))).first()[0]
    monkeypatch.setattr(blocking, "KEY_ROWS", n // 2 + 1)
    monkeypatch.setattr(blocking, "KEY_ROWS_X", 0)
    for near in (20_000, 1):  # two rounds, with a broadcast and without
        monkeypatch.setattr(blocking, "NEAR", near)
        monkeypatch.setattr(blocking, "NEAR_ROUNDS", 2)
        mark = shared.written()
        top = blocking.best_pairs(keys, usable, sets, catalog._scores(), catalog._cheap, catalog.SETTINGS)
        assert top.columns == [*pairs.columns, "rank_cheap"] and read(top) == want
        if near > 1:  # all pairs were written before
            assert not [t for t in shared._written[mark:] if "key_mask" in t.columns and "rank_cheap" not in t.columns]
        shared.sweep(mark)


def test_missed_pairs_are_explained_where_their_records_meet(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    bases = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(12)]
    docs = [(i, bases[int(i % 12 * rng.random())] + f" x{i % 7}" * rng.randint(0, 2), "en") for i in range(240)]  # large groups that begin alike
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    settings = replace(catalog.SETTINGS, topk_joint=2, topk_name=1, topk_addr=1, max_block_target=20)
    for where in (catalog, checks):
        monkeypatch.setattr(where, "SETTINGS", settings)
    old, new = catalog.SETTINGS.block_limits(0), ("b <= 300 AND a * b <= 20000", "b <= 20 AND a * b <= 20000")
    sql = checks.MISSED.replace(*new).replace("r1 <= 20 OR r2 <= 5 OR r3 <= 5", "r1 <= 2 OR r2 <= 1 OR r3 <= 1")
    assert sql.count(new[1]) == sql.count("r1 <= 2 OR r2 <= 1 OR r3 <= 1") == 1 and old == (20, 20000)
    order = ["s1_id", "tgt_id", "shared_keys", "n_better", "reason"]
    want = sorted(con.sql(f"SELECT {', '.join(order)} FROM ({sql})").fetchall(), key=str)
    assert {r[4] for r in want} == {"no shared key", "blocks too large", "ranked out"} and len(want) > 1000
    for cell in (1000, 7):
        monkeypatch.setattr(blocking, "CELL", cell)
        mark = shared.written()
        out = checks.missed_pairs(spark, str(tmp_path))
        assert sorted(map(tuple, out.select(*order).collect()), key=str) == want
        # Pairs were shuffled by both ids, once for each key.
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Exchange" in x and "s1_id" in x and "tgt_id" in x]
        shared.sweep(mark)


def test_words_of_a_string_count_as_an_array_of_them_does(spark):
    rng = random.Random(6)
    rows = [(1 + i % 3, f"S{1 + i % 3}-{i}", " ".join(f"w{int(rng.paretovariate(0.4)) % 900}" for _ in range(rng.randint(0, 30)))) for i in range(200)] + [(1, "S1-none", None)]
    recs = spark.createDataFrame(rows, "src tinyint, entity_id string, t string").repartition(3)
    arrays = recs.withColumn("t", fixture.words("t"))
    read = lambda df: sorted(map(str, df.collect()))
    stats = blocking.numbered(blocking.token_df(arrays, "t"))
    assert read(blocking.token_df(recs, "t")) == read(blocking.token_df(arrays.where("t IS NOT NULL"), "t"))
    assert read(blocking.token_sets(recs, "t", stats, "[0-4]$")) == read(blocking.token_sets(arrays, "t", stats, "[0-4]$"))


def test_fixture_cuts_texts_without_taking_them_apart(spark, tmp_path):
    docs = ["", None, "One", " a b  c-d e f ", "a b c d e f", "a b c d e f g", "A b c d e f x9y 12 é7z", "!!", "a b c d e f " + "q" * 50_000 + " z1", "1 2 3 4 5 6 nine 0x"]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(docs)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    recs = fixture.records(spark, str(tmp_path))
    for r in recs.collect():
        words = [w for w in re.sub("[^a-z0-9]+", " ", (docs[int(r["entity_id"][3:])] or "").lower()).split(" ") if w]
        assert (r["name_tokens"], r["addr_tokens"]) == (words[:6], words[6:])
        assert r["addr_house"] == next((w for w in words[6:] if re.search("[0-9]", w)), "")
        assert r["full"] == hashlib.sha256(" ".join(words).encode()).hexdigest()
    plan = recs.select("addr_house")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan  # whole addresses were split for one word
