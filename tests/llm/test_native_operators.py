"""PII, mixing, licenses and decontamination: no Python on the executors."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import pytest

from kinweave.llm import contamination, licenses, mixing, pii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return (text or "").encode().lower().decode()


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


# --- decontamination ---


def leaks(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall(ascii_lower(text))
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[i : i + size])].add(str(item))
    out = []
    for i, text in docs:
        w = WORD.findall(ascii_lower(text))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (key := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[key]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture
def item_rows(prose):
    return [(1, prose(1, 30)), (2, prose(2, 12)), (3, "alpha beta"), (4, "omega"), (5, None), (6, "  !"), (7, prose(2, 12)), (10, prose(3, 9)), (8, "go go go go go go go go go go go go")]


def test_decontamination_matches_brute_force(spark, docs, prose, item_rows):
    w = prose(1, 30).split()
    rows = [(i, prose(i + 20, 40)) for i in range(20)]
    rows += [(30, "x " + prose(1, 30).upper() + " y"), (31, " ".join(w[5:15])), (32, " ".join(w[5:14])), (33, prose(2, 12) + " " + prose(2, 12)), (34, "Alpha, beta; OMEGA")]
    rows += [(40, None), (41, ""), (42, "go " * 40), (43, prose(3, 9)), (44, " ".join(w[:12] + ["zz"] + w[12:]))]
    items = spark.createDataFrame(item_rows, "item_id long, text string")
    found = contamination.digest(contamination.contaminated(docs(rows), items))
    assert sorted(map(tuple, found.collect()), key=str) == leaks(rows, item_rows)
    assert not re.search("Python|Arrow|Pandas", plan(found))


@pytest.mark.parametrize("ids", [0, 1_000])
def test_decontamination_by_shuffle_and_edge_tables(spark, docs, prose, item_rows, monkeypatch, ids):
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(contamination, "BROADCAST_PLACES", 0)
    monkeypatch.setattr(contamination, "BROADCAST_IDS", ids)
    rows = [(1, prose(1, 30)), (1, prose(2, 12)), (2, prose(9, 20)), (None, prose(3, 9)), (None, None)]
    items = spark.createDataFrame(item_rows, "item_id long, text string")
    extra = docs(rows).selectExpr("*", "1 AS leak", "2 AS cands_", "3 AS n", "4 AS h")
    got = map(tuple, contamination.digest(contamination.contaminated(extra, items)).collect())
    assert sorted(got, key=str) == sorted(leaks(rows, item_rows), key=str)
    assert contamination.contaminated(docs([]), items).collect() == []
    assert [r["n_hit"] for r in contamination.digest(contamination.contaminated(docs(rows), items.limit(0))).collect()] == [0] * 5


# --- licenses ---


def phrase_rows(rows):
    out = {}
    for i, text in rows:
        w = WORD.findall(ascii_lower(text))
        at = [(s, label) for p, label in licenses.PHRASES.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        starts = [s for s, _ in at]
        out[i] = (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))
    return out


def test_licenses(docs, prose):
    mit = dict(licenses.TEMPLATES)["mit-text"]
    changed = mit.replace("merge", "merge quietly").replace("sublicense", "lend")
    rows = [(i, prose(i, 50)) for i in range(10)] + [(20, prose(1, 30) + " " + mit), (21, prose(2, 500) + " " + changed + " " + prose(3, 20)), (22, " ".join(mit.split()[:30]))]
    rows += [(30, "The MIT-License, mit license; MIT LICENSE"), (31, "cc BY"), (32, None), (33, ""), (34, "apache"), (35, "the GNU General Public License and the Apache license " * 50)]
    found = licenses.scan(docs(rows))
    got = {r["doc_id"]: r for r in found.collect()}
    for i, want in phrase_rows(rows).items():
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert 0 <= r["score"] <= 1 and set(filter(None, want[4].split(","))) <= set(r["labels"].split(","))
    assert "mit-text" in got[20]["labels"] and "mit-text" in got[21]["labels"] and got[22]["labels"] == ""
    assert got[0]["labels"] == "" and got[20]["score"] > 0.99
    assert not re.search("Python|Arrow|Pandas", plan(found))


def test_neighbouring_diagonals_are_merged(docs):
    text = dict(licenses.TEMPLATES)["isc-text"].split()
    text.insert(12, "really")
    spans = licenses.spans(docs([(1, "a b c " + " ".join(text))])).where("label = 'isc-text'").collect()
    assert len(spans) == 1 and spans[0]["verified"] and spans[0]["first_word"] == 3


def test_licenses_with_one_word_more_or_less_anywhere(docs, prose):
    rows, want = [], {}
    for label, text in licenses.TEMPLATES:
        w = text.split()
        if len(w) < 20:
            continue
        for i in range(len(w) + 1):
            for changed in (w[:i] + ["zzz"] + w[i:], w[:i] + w[i + 1 :]):
                want[len(rows)] = label
                rows.append((len(rows), f"{prose(i, 30)} {' '.join(changed)} {prose(i + 500, 30)}"))
    found = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(docs(rows)).collect()}
    assert {want[i] for i in want if want[i] not in found[i]} == set()


def plain_cover(template, words):
    """Share of the template's words in k-grams that stand in words at all: no span can have more."""
    have = {tuple(words[i : i + licenses.K]) for i in range(len(words))}
    at = [i for i in range(len(template) - licenses.K + 1) if tuple(template[i : i + licenses.K]) in have]
    return len({i + j for i in at for j in range(licenses.K)}) / len(template)


def test_each_template_keeps_its_label_alone_when_a_word_changes(docs, prose):
    rows, want = [], {}
    for label, text in licenses.TEMPLATES:
        w = WORD.findall(ascii_lower(text))
        for i in (0, len(w) // 3, 2 * len(w) // 3, len(w) - 1):
            for changed in (w, w[:i] + ["zzz"] + w[i:], w[:i] + w[i + 1 :], w[:i] + ["zzz"] + w[i + 1 :]):
                # Without its one word of difference the share-alike notice is the other one.
                if plain_cover(w, changed) >= licenses.COVERED and ("sharealike" in changed) == ("sharealike" in w):
                    want[len(rows)] = label
                    rows.append((len(rows), f"{prose(i, 30)} {' '.join(changed)} {prose(i + 500, 30)}"))
    assert {want[i] for i in want} == {label for label, _ in licenses.TEMPLATES}
    found = {r["doc_id"]: r for r in licenses.scan(docs(rows)).collect()}
    wrong = [(rows[i][1], found[i]["labels"]) for i in want if set(found[i]["labels"].split(",")) - set(found[i]["base_labels"].split(",")) != {want[i]}]
    assert wrong == []
    con = duckdb.connect()
    con.register("documents", docs(rows).toPandas())
    assert sorted(con.sql(licenses.SQL).fetchall(), key=str) == sorted(map(tuple, found.values()), key=str)


def test_notices_side_by_side_and_far_into_a_long_text(docs, prose):
    t = dict(licenses.TEMPLATES)
    rows = [(1, t["cc-by-4.0-notice"] + " " + t["cc-by-sa-4.0-notice"] + " " + t["mit-notice"]), (2, prose(1, 20_000) + " " + t["bsd-text"] + " " + prose(2, 5_000)), (3, (t["mit-text"] + " ") * 30)]
    rows += [(4, t["isc-text"]), (4, prose(3, 60)), (None, t["isc-text"]), (None, prose(4, 9))]
    got = sorted(((r["doc_id"], r["labels"]) for r in licenses.scan(docs(rows)).collect()), key=str)
    assert got == sorted([(1, "cc-by-4.0-notice,cc-by-sa-4.0-notice,mit,mit-notice"), (2, "bsd-text"), (3, "mit-text"), (4, "isc-text"), (4, ""), (None, "isc-text"), (None, "")], key=str)


def test_licenses_of_empty_tables_and_clashing_columns(docs):
    assert licenses.scan(docs([])).collect() == []
    frame = docs([(1, "mit license"), (1, "mit license")]).selectExpr("*", "'x' AS labels", "1 AS pos", "2 AS h")
    assert [r["base_labels"] for r in licenses.scan(frame).collect()] == ["mit", "mit"]


# --- mixing ---


def mix_rows(seed=0):
    rows = [(i, "w " * (5 + i % 7), "en", "big", 1) for i in range(400)]
    rows += [(1000 + i, "a b c d", "en", f"s{i % 5}", 1) for i in range(60)]
    return rows + [(2000 + i, "n n", "en", None, 1) for i in range(9)] + [(3000, None, "en", "void", 0), (3001, "", "en", "void", 0)]


def test_mixing_matches_the_sql(docs):
    frame = docs(mix_rows())
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    mixed = mixing.mix(frame).select("doc_id", "source", "epoch", "block", "place")
    want = [tuple(None if x != x else x for x in r) for r in con.sql(mixing.SQL).fetchall()]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, mixed.collect()), key=key) == sorted(want, key=key)
    assert not re.search("Python|Arrow|Pandas", plan(mixed))


def test_budgets_entropy_and_repeats(docs):
    frame = docs(mix_rows())
    drawn = mixing.mix(frame, max_repeats=3.0).collect()
    tokens = Counter()
    for r in drawn:
        tokens[r["source"]] += len(r["text"].split())
    p = [n / sum(tokens.values()) for n in tokens.values()]
    own = Counter()
    for _, t, _, s, _ in mix_rows():
        own[s] += len((t or "").split())
    assert max(tokens[s] / own[s] for s in tokens) <= 3.0 + 1e-9
    natural = -sum(x / sum(own.values()) * math.log(x / sum(own.values())) for x in own.values() if x)
    assert -sum(x * math.log(x) for x in p) > natural and "void" not in tokens
    per = Counter((r["doc_id"], r["epoch"]) for r in drawn)
    assert max(per.values()) == 1  # an epoch is a permutation


@pytest.mark.parametrize("budget", [None, 8_500, 700])
def test_every_weighted_source_is_drawn_to_its_budget(docs, budget):
    rows = [(i, "w " * 1000, "en", "ab"[i // 4], 1) for i in range(8)] + [(100, "w " * 9000, "en", "c", 1)]
    rows += [(200 + i, f"t{i} " * (3 + i % 40), "en", "d", 1) for i in range(600)] + [(None, "x y z", "en", "e", 1), (None, "u v", "en", "e", 1)]
    frame = docs(rows)
    mixed = mixing.mix(frame, budget)
    got = {r["source"]: r for r in mixing.shares(frame, mixed).collect()}
    per = frame.withColumn("tokens", mixing.tokens(frame["text"])).groupBy("source").sum("tokens").withColumnRenamed("sum(tokens)", "tokens").select("tokens")
    row = mixing.exponent(per, budget, mixing.ENTROPY_SHARE, mixing.MAX_REPEATS).first()
    for name, r in got.items():
        target = (r["tokens"] / row["total"]) ** row["alpha"] / row["z"] * row["budget"]
        longest = max(len(t.split()) for _, t, _, s, _ in rows if s == name)
        assert target - 0.5 <= r["drawn"] < target + longest, name
        assert r["drawn"] > 0 or target <= 0.5, name
    if budget is None:
        con = duckdb.connect()
        con.register("documents", frame.toPandas().astype({"doc_id": "Int64"}))
        want = [tuple(None if x != x else x for x in r) for r in con.sql(mixing.SQL).fetchall()]
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, mixed.select("doc_id", "source", "epoch", "block", "place").collect()), key=key) == sorted(want, key=key)


def test_mixing_edges(docs):
    assert mixing.mix(docs([])).collect() == []
    assert mixing.mix(docs([(1, None), (2, "")])).collect() == []
    frame = docs([(1, "a b"), (1, "a b")]).selectExpr("*", "9 AS epoch", "8 AS block", "7 AS place")
    assert [r["epoch"] for r in mixing.mix(frame).collect()] == [0, 0]


# --- PII ---

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return True


def base_spans(text):
    return [(k, m.start(), m.end()) for k, rx in PLAIN.items() for m in re.finditer(rx, text or "") if passes(k, m.group())]


HARD = [
    "a@b.c_x@d.e", "1.2.3.4.5.6.7.8", "+1 (2) 345-678 90.", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "é 4111111111111111 \U0001f600 x@y.zz",
    "999.1.1.1 0001.2.3.4 256.1.1.1", "++1234567890", " +12 345 678 9 (", "1" * 60, "x@y", "a@b.c@d.e", None, "", "@@ a@b..c", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
    "+1" * 20, "12345678901234567890", "9" * 20_000, "a" * 20_000 + "@", "1 " * 5_000, "+" + "1 " * 5_000, "a@b.co " * 300,
]


def test_seed_spans_match_plain_expressions(docs):
    rows = list(enumerate(HARD))
    found = pii.digest(pii.find(docs(rows)))
    got = {r["doc_id"]: r for r in found.collect()}
    for i, text in rows:
        want = base_spans(text)
        r = got[i]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in want) for k in PLAIN], text
        assert r["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % s for s in want).encode()).hexdigest(), text
    assert not re.search("Python|Arrow|Pandas", plan(found))


def test_context_discovers_unseen_identifiers(docs):
    rows = [(i, f"please phone +1 555 010 {1000 + i} today, room {i}") for i in range(40)]
    rows += [(100, "please phone 5550-199-77 today, then rest"), (101, "order 777-12345 shipped at noon")]
    rows += [(200 + i, f"invoice 90{i}12345 shipped at noon") for i in range(30)]
    got = {r["doc_id"]: r for r in pii.find(docs(rows)).collect()}
    assert [tuple(s) for s in got[100]["added"]] == [("phone", 13, 24)] and got[100]["base"] == []
    assert all(got[k]["added"] == [] for k in [101, *range(200, 230)])
    assert "5550-199-77" not in "".join(r["text"] for r in pii.redacted(docs(rows)).collect())


def test_one_strong_pattern_discovers_identifiers_of_any_form(docs):
    rows = [(i, f"please phone +1 555 010 {1000 + i} w{chr(97 + i % 26)}{chr(97 + i // 26)} on") for i in range(60)]
    forms = ["5550-199-77", "555 123 4567", "(020) 7946-0958", "4417"]
    rows += [(100 + i, f"please phone {x} rare{chr(97 + i)} then") for i, x in enumerate(forms)]
    rows += [(200 + i, f"room {x} rest{chr(97 + i)} then") for i, x in enumerate(["8-199-77", "777 123 4567", "12"])]
    # Copies are no support, and an identifier beside another does not tell its kind.
    rows += [(400 + i, "ask joe a.b@c.de at once") for i in range(30)] + [(450, "ask joe 88-99-777 rarey then")]
    rows += [(500 + i, f"u{chr(97 + i)} m{i}@c.de 10.0.0.{i} on") for i in range(26)] + [(550, "rarex 4417-99-55 10.0.1.1 on")]
    # Most occurrences of this value stand beside other words.
    rows += [(300, "please phone 2024 rarez then")] + [(301 + i, f"year 2024 was {chr(97 + i)}") for i in range(9)]
    got = {r["doc_id"]: [tuple(s) for s in r["added"]] for r in pii.find(docs(rows)).collect()}
    assert [got[100 + i] for i in range(len(forms))] == [[("phone", 13, 13 + len(x))] for x in forms]
    assert all(got[i] == [] for i in got if not 100 <= i < 200)


LONG = {
    "dashes": "a1 " + "-" * 1_000_000,
    "dots": "." * 1_000_000 + "1",
    "letters and dashes": "a-" * 500_000,
    "digits and blanks": "1 " * 300_000,
    "addresses": " ".join(f"name{i}@host{i % 7}.org" for i in range(50_000)),
    "numbers": " ".join(f"no. {i}-{i}x" for i in range(40_000)),
}


@pytest.mark.parametrize("name", LONG)
def test_long_texts_take_time_in_proportion(docs, name):
    text = LONG[name]
    frame = docs([(1, text)])
    began = time.monotonic()
    row = pii.digest(pii.find(frame)).first()
    want = base_spans(text) if name in ("addresses", "numbers") else []
    assert row["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % s for s in want).encode()).hexdigest()
    if name == "addresses":
        assert pii.redacted(frame).first()["text"] == " ".join(["[EMAIL]"] * 50_000)
    assert time.monotonic() - began < 60  # of which starting jobs is the greater part


def plain_things(text):
    """Identifier-like strings outside the base spans: (start, end)."""
    taken = [(a, b) for _, a, b in base_spans(text)]
    out = []
    for m in re.finditer(pii.THING, text):
        a = m.end() - len(m.group().lstrip(pii.SIGNS))
        if not any(a < y and x < m.end() for x, y in taken):
            out.append((a, m.end()))
    return out


def plain_discovery(rows):
    """doc_id -> added spans, by loops over occurrences."""
    seen = []
    plain = lambda w: re.sub("[0-9]+", "0", ascii_lower(w))
    for i, text in rows:
        for kind, a, b in [*base_spans(text), *((None, *x) for x in plain_things(text))]:
            left = re.search(r"(\S+)[\s\"'(<]*$", text[max(0, a - 32) : a])
            right = re.search(r"^[\s\"')>,;]*(\S+)", text[b : b + 32])
            seen.append((i, kind, a, b, ascii_lower(text[a:b]), "L " + plain(left.group(1) if left else ""), "R " + plain(right.group(1) if right else "")))
    edges, kind_of, told = Counter(), {}, []
    for _, kind, _, _, value, *sides in seen:
        sides = [x for x in sides if len(x) > 2]
        if sides:
            told.append((kind, value, sides))
        for x in sides:
            edges[x, value] += 1
            if kind:
                kind_of.setdefault(value, set()).add(kind)
    scores = {(v, k): 1.0 for v, ks in kind_of.items() for k in ks}
    for _ in range(pii.ROUNDS):
        patterns = {}
        for x in {e[0] for e in edges}:
            own = [(v, n) for (y, v), n in edges.items() if y == x]
            for k in pii.KINDS:
                share = sum(n * scores.get((v, k), 0) for v, n in own) / (sum(n for _, n in own) + pii.DISCOUNT)
                alone = 0.0 if re.search("[0-9@]", x) else sum(scores.get((v, k), 0) for v, _ in own) / (len(own) + pii.DISCOUNT)
                if max(share, alone) >= pii.CONFIDENT:
                    patterns[x, k] = share, alone
        new = {(v, k): 1.0 for v, ks in kind_of.items() for k in ks}
        for v in {v for kind, v, _ in told if kind is None} - set(kind_of):
            mine = [sides for kind, w, sides in told if w == v and kind is None]
            for k in pii.KINDS:
                got = [[patterns.get((x, k), (0.0, 0.0)) for x in sides] for sides in mine]
                mean = sum(p for g in got for p, _ in g) / sum(map(len, got))
                best = sum(max(max(a for _, a in g), sum(p for p, _ in g) / 2) for g in got) / len(got)
                new[v, k] = max(mean, best)
        scores = new
    found = defaultdict(list)
    for i, kind, a, b, value, *_ in seen:
        if kind is None and value not in kind_of:
            score, k = max((scores.get((value, k), 0), k) for k in pii.KINDS)
            if score >= pii.ACCEPT:
                found[i].append((k, a, b))
    return found


def test_added_spans_match_brute_force(docs):
    rng = random.Random(5)
    lead = {"phone": ["call", "phone", "ring"], "email": ["mail", "write"], "card": ["card"], "ip": ["host"]}
    make = {
        "phone": lambda: f"+1 555 {rng.randint(100, 999)} {rng.randint(1000, 9999)}",
        "email": lambda: f"u{rng.randint(0, 400)}@h{rng.randint(0, 9)}.org",
        "card": lambda: "4111 1111 1111 1111",
        "ip": lambda: f"10.{rng.randint(0, 9)}.0.{rng.randint(1, 250)}",
    }
    words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    rows = []
    for i in range(400):
        parts = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(list(lead))
            thing = make[kind]() if rng.random() < 0.7 else rng.choice(["555-0199", "user7@local", "x9-22", "77 1234", f"no.{rng.randint(1, 99)}"])
            parts += [rng.choice(words), rng.choice(lead[kind] + words[:2] * (rng.random() < 0.2)), thing, rng.choice(words), rng.choice(words)]
        rows.append((i, " ".join(parts)))
    want = plain_discovery(rows)
    got = {r["doc_id"]: sorted(map(tuple, r["added"])) for r in pii.find(docs(rows)).collect() if r["added"]}
    assert got == {i: sorted(x) for i, x in want.items()} and len(got) > 20


def test_redaction_and_edges(docs):
    rows = [(1, "mail a@b.co or 10.0.0.1"), (2, None), (3, "+4111111111111111 x"), (4, "plain")]
    got = {r["doc_id"]: r["text"] for r in pii.redacted(docs(rows)).collect()}
    assert got[1] == "mail [EMAIL] or [IP]" and got[2] is None and got[4] == "plain"
    assert pii.find(docs([])).collect() == [] and pii.redacted(docs([])).collect() == []
    twice = docs([(1, "a@b.co"), (1, "a@b.co")]).selectExpr("*", "1 AS base", "2 AS rid", "3 AS mark")
    assert [len(r["base"]) for r in pii.find(twice).collect()] == [1, 1]
    assert [r["text"] for r in pii.redacted(twice).collect()] == ["[EMAIL]"] * 2
