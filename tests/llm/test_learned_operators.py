"""Language identification, toxicity and quality rules: fitted on the way."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from kinweave.llm import common, languages, quality, svm, toxicity

SOUNDS = {"en": ("the", "ing", "ou"), "de": ("sch", "ung", "ei"), "fr": ("eau", "que", "oi"), "es": ("cion", "ado", "que"), "xx": ("zz", "yy", "ww")}


@pytest.fixture(scope="module")
def tongues():
    rng = random.Random(1)
    rows = []
    for i in range(600):
        code = rng.choice(list(SOUNDS))
        text = " ".join("".join(rng.choice(SOUNDS[code]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
        rows.append((i, text, code if i % 11 else None, f"s{i % 3}", 1))
    return rows


def test_languages_on_held_out_rows(docs, tongues):
    got = languages.identify(docs(tongues)).collect()
    held = [r for r in got if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 50 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(tongues)


def test_languages_edges(docs, tongues):
    odd = [(9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (9002, "123 !?", "en", "s", 0), (9003, "the " * 50_000, None, None, 0), (9004, "the ing", "en", "s", 0), (9004, "the ing", "en", "s", 0)]
    frame = docs(tongues + odd).selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS extra")
    rows = [r for r in languages.identify(frame).collect() if r["doc_id"] >= 9000]
    got = {r["doc_id"]: r for r in rows}
    assert [got[k]["lang_pred"] for k in (9000, 9001, 9002)] == ["und"] * 3 and got[9003]["lang_pred"] == "en"
    assert sum(r["doc_id"] == 9004 for r in rows) == 2 and got[9004]["extra"] == 3
    assert languages.identify(docs([])).collect() == []
    assert [r["lang_pred"] for r in languages.identify(docs([(1, "abc", None, None, 1)])).collect()] == ["und"]
    assert [r["lang_pred"] for r in languages.identify(docs([(i, "abc", "q", None, 1) for i in range(9)])).collect()] == ["q"] * 9


def test_prediction_ignores_lang_source_and_batch(docs, tongues):
    model = languages.fit_sample(docs(tongues))
    texts = [t.encode() for _, t, *_ in tongues[:40]]
    together = languages.predict(model, texts)
    alone = [languages.predict(model, [t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone]
    assert together[1] == pytest.approx([a[1][0] for a in alone], abs=1e-6)


def test_fitting_is_the_same_for_any_partitions(spark, docs, tongues, marked, monkeypatch):
    monkeypatch.setattr(languages, "FIT_ROWS", 200)
    bad, labels, _ = marked
    tags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    for frame, other in ((docs(tongues), docs(bad)), (docs(tongues[::-1]).repartition(7), docs(bad[::-1]).repartition(5, "text")), (docs(tongues).repartition(2, "text"), docs(bad).coalesce(1))):
        model = languages.fit_sample(frame, rows=200)
        tox = toxicity.fit_sample(other, tags)
        seen.append((languages.predict(model, [t.encode() for _, t, *_ in tongues[:50]]), tox["names"], tox["weights"]))
    assert seen[0] == seen[1] == seen[2] and seen[0][1]


def test_fit_rows_are_bounded_in_rows_and_bytes_and_never_cut(docs):
    rows = [(i, f"t{i} " * (1 + i % 50), "a" if i % 3 else "b") for i in range(2000)] + [(5000, "long " * 5_000, "a")] + [(6000, "same text", "b")] * 500
    full = docs([(i, t, k, "s", 0) for i, t, k in rows])
    got = common.fit_rows(full, "lang", {"a": 300, "b": 300}, {"a": 1334, "b": 1167}, 40_000)
    texts = {t.encode() for _, t, _ in rows}
    for label in "ab":
        mine = [t for t, k in got if k == label]
        assert 20 < len(mine) <= 391 and sum(map(len, mine)) <= 20_000 and len(set(mine)) == len(mine) and set(mine) <= texts
    assert not any(t.startswith(b"long") for t, _ in got)


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = np.hstack([rng.normal(size=(200, 2)), np.ones((200, 1))]).astype(np.float32)
    y = np.where(x[:, 0] + x[:, 1] > 0.1, 1, -1)
    assert (np.sign(x @ svm.fit(x, y, c=10, passes=50)) == y).mean() > 0.97


@pytest.fixture(scope="module")
def marked():
    rng = random.Random(2)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(clean) for _ in range(rng.randint(20, 60))]
        bad = rng.random() < 0.15
        if bad:
            kind = rng.random() < 0.5
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["zonker", "plorp", "wrexit"]) if kind else "quarl" + rng.choice(clean)
        rows.append((i, " ".join(words), "en", "s", 1))
        if i % 3:
            labels.append((i, 1, int(bad)))
    return rows, labels, {i: any(x in t for x in ("zonker", "plorp", "wrexit", "quarl")) for i, t, *_ in rows}


def test_toxicity_on_rows_never_learned_from(spark, docs, marked):
    rows, labels, truth = marked
    got = toxicity.score(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)


def test_toxicity_edges(spark, docs, marked):
    rows, labels, _ = marked
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = docs([(1, None), (2, ""), (3, "zonker " * 30_000), (4, "a"), (4, "a")]).selectExpr("*", "1 AS score", "2 AS toxic")
    assert {r["predicted"] for r in toxicity.score(odd, none).collect()} == {0}
    assert toxicity.score(docs([]), none).collect() == []
    model = toxicity.fit([t.encode() for _, t, *_ in rows], [1 if "zonker" in t else 0 for _, t, *_ in rows])
    got = [(r["doc_id"], r["predicted"]) for r in toxicity.score_texts(odd, model).collect()]
    assert sorted(got) == [(1, 0), (2, 0), (3, 1), (4, 0), (4, 0)]


def test_label_model_divides_the_evidence_of_copied_voters():
    rng = np.random.default_rng(1)
    y = rng.random(2000) < 0.3
    vote = lambda a, b: np.where(y, rng.random(2000) < a, rng.random(2000) < b)
    one, two = vote(0.7, 0.05), vote(0.7, 0.05)
    v = np.stack([one, one, one, two], axis=1).astype(np.float32)
    q, keep = toxicity.label_model(v, np.where(rng.random(2000) < 0.2, y, -1))
    assert keep[0] < 0.4 < keep[3] and ((q > 0.5) == y).mean() > 0.85


# --- quality ---


def plain_counts(text):
    raw = (text or "").encode()
    words = raw.split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {g for g in grams if grams.count(g) > 1}
    inside = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return [len(words), sum(len(w.decode()) for w in words), sum(map((text or "").count, "#*$%&|<>")), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)]


def test_quality_counts_and_verdicts(docs, prose):
    rows = [(i, prose(i, 60 + i % 40), "en" if i % 2 else None, "hot" if i % 3 else "s", 1) for i in range(120)]
    rows += [(500, " | ".join(prose(1, 90).split()), "en", "hot", 1), (501, prose(2, 80).upper().replace(" ", "!! "), "en", "hot", 1)]
    rows += [(600, None, "en", "hot", 0), (601, "", "en", None, 0), (602, "a b c " * 40, "en", "s", 1), (603, "x\nx\n \n \nx y\nx", "en", "s", 1), (604, prose(8, 20_000), "en", "hot", 1), (605, "é\x85ñ ü " * 3, "lone", "lone", 1)]
    rows += [(606, prose(77, 70), "only", "one", 1), (606, prose(77, 70), "only", "one", 1)]
    got = {r["doc_id"]: r for r in quality.judge(docs(rows)).collect()}
    for i, text, *_ in rows:
        r = got[i]
        c = plain_counts(text) if i != 604 else None
        if c:
            assert [r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == c, i
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert all(got[i]["kept"] for i in range(120)) and not got[500]["kept"] and not got[501]["kept"] and got[606]["kept"]


def test_estimates_are_the_least_determinants_by_brute_force(spark):
    rng = np.random.default_rng(3)
    p, groups = len(quality.NAMES), {}
    mixed = rng.normal(size=(p, p)) * 0.05
    for g in range(4):
        x = rng.normal(size=(12, p)) @ mixed + g
        x[:3] += rng.normal(size=(3, p)) + 2  # as many outliers as an estimate can bear
        groups[f"g{g}"] = x
    groups["same"] = np.tile([1.0, 0, 0, 0, 0.5, 0], (12, 1))
    rows = [(g, *map(float, r), 0.001, 0.002, 0.003) for g, x in groups.items() for r in x]
    frame = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{c} double" for c in quality._VECTOR))
    noise = np.diag([{"words": 0.001, "lines": 0.002, "letters": 0.003}[quality.PER[c]] * quality.AT_ONCE[c] for c in quality.NAMES])
    for r in quality.estimates(frame).collect():
        x = groups[r["grp"]]
        sets = [x[list(c)] for c in combinations(range(12), 9)]
        best = min(sets, key=lambda y: np.linalg.slogdet(np.cov(y.T, bias=True) + noise)[1])
        w = np.zeros((p, p))
        w[np.tril_indices(p)] = r["w"]
        assert r["center"] == pytest.approx(best.mean(axis=0), abs=1e-9)
        assert np.linalg.inv(w.T @ w) == pytest.approx(np.cov(best.T, bias=True) + noise, abs=1e-9)
        assert r["scale"] >= 1 and r["cut"] >= quality.LEVEL_CHI2


def test_repeated_words_of_any_text():
    rng = random.Random(4)
    for n in [*range(0, 12), 50, 300]:
        for k in (1, 2, 4, 30):
            words = [f"w{rng.randrange(k)}".encode() for _ in range(n)]
            assert quality.repeated_words(words) == plain_counts(b" ".join(words).decode())[4]


def test_quality_edges(docs, prose):
    assert quality.judge(docs([])).collect() == []
    frame = docs([(1, prose(1, 60)), (2, "short")]).selectExpr("*", "1 AS kept", "2 AS grp", "3 AS symbols")
    assert {r["doc_id"]: r["kept"] for r in quality.judge(frame).collect()} == {1: True, 2: False}
