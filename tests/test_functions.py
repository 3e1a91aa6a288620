import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.functions import cleaning, indic, similarity, tables, text

short = st.text(alphabet="abc ", max_size=9)


def run(spark, f, *values):
    frame = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return frame.select(f(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


# --- similarities against plain definitions ---


def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=200, deadline=None)
@given(short, short)
def test_lcs(a, b):
    assert similarity.lcs(a, b) == plain_lcs(a, b)


@settings(max_examples=100, deadline=None)
@given(short, short)
def test_symmetry_and_bounds(a, b):
    for kind in ("ratio", "tsort", "tset", "partial", "jw"):
        s = similarity.KINDS[kind](a, b)
        assert 0 <= s <= 100 and s == pytest.approx(similarity.KINDS[kind](b, a))
    assert similarity.osa(a, b) == similarity.osa(b, a) <= max(len(a), len(b))


@pytest.mark.parametrize(
    "kind, a, b, want",
    [("ratio", "", "", 100), ("tset", "", "", 0), ("tset", "a b", "b a c", 100), ("tsort", "b a", "a b", 100), ("ratio", "abcd", "abxd", 75), ("partial", "abc", "xxabcxx", 100), ("jw", "abcd", "axyz", 50), ("jw", "martha", "marhta", 96.1111)],
)
def test_known_similarities(kind, a, b, want):
    assert similarity.KINDS[kind](a, b) == pytest.approx(want, abs=1e-3)


def test_osa_counts_a_swap_once():
    assert similarity.osa("limitde", "limited") == 1 and similarity.osa("ca", "abc") == 3


def test_similarity_columns_take_nulls(spark):
    frame = spark.createDataFrame([("ab", "ab"), (None, None), (None, "a")], "a string, b string")
    got = [r[0] for r in frame.select(similarity.pair_similarity("ratio", F.col("a"), F.col("b"))).collect()]
    assert got == [100.0, 100.0, 0.0]


# --- native string functions ---


@pytest.mark.parametrize(
    "f, given_, want",
    [
        (text.phonetic_key, "private", "prbt"), (text.phonetic_key, "praivet", "prbt"), (text.phonetic_key, "", ""),
        (text.skeleton, "international", "intrn"), (text.skeleton, "aabb", "ab"), (text.skeleton, "whoa9", "w"),
        (text.strip_ordinal, "12th", "12"), (text.strip_ordinal, "th", "th"),
        (lambda c: text.repair_digits(c, True), "gu1f", "gulf"), (lambda c: text.repair_digits(c, True), "8rothers", "brothers"), (lambda c: text.repair_digits(c, True), "denta1", "dental"),
        (lambda c: text.repair_digits(c, False), "denta1", "denta1"), (lambda c: text.repair_digits(c, True), "12th", "12th"), (lambda c: text.repair_digits(c, True), "a11b", "a11b"),
        (text.split_doubled, "llcllc", "llc"), (text.split_doubled, "bobo", "bobo"), (text.unglue, "lecole", "ecole"), (text.unglue, "lyser", "yser"), (text.unglue, "lange", "lange"),
        (text.merge_single_letters, "l l c", "llc"), (text.merge_single_letters, "s k enterprises", "sk enterprises"),
        (text.normalize_country, "U.S.A", "us"), (text.normalize_country, "République Française", "fr"), (text.normalize_country, "New Zealand", "new_zealand"),
        (text.base_clean, "no-436", "no 436"), (text.base_clean, "b-195", "b195"), (text.base_clean, "Gabriela's", "gabrielas"), (text.base_clean, "l'Europe", "europe"), (text.base_clean, "Straße & Söhne", "strasse and sohne"),
    ],
)
def test_native_functions(spark, f, given_, want):
    assert run(spark, f, given_) == want


@pytest.mark.parametrize("raw", ["no-436", "b-195 x", "Café-Bar l'été", "8-2-293/82/a", "M & M + Co.", "baule-escoublac", "  a / b - c "])
def test_native_and_plain_cleaning_agree(spark, raw):
    clean = run(spark, text.base_clean, raw)
    assert clean == cleaning.base_clean(raw)
    assert run(spark, lambda c: text.tokens(text.base_clean(c)), raw) == cleaning.tokenize(clean)


def test_abbreviation(spark):
    pairs = [("mfg", "manufacturing", True), ("ctr", "center", True), ("abc", "ab", False), ("xb", "ab", False), ("a1", "ab1", False)]
    for a, b, want in pairs:
        assert run(spark, text.is_abbreviation, a, b) is want


def test_drop_consecutive(spark):
    frame = spark.createDataFrame([(["a", "a", "b", "a"],)], "w array<string>")
    assert frame.select(text.drop_consecutive(F.col("w"))).first()[0] == ["a", "b", "a"]


def test_logit_is_clipped(spark):
    got = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double").select(text.logit(F.col("p"))).collect()
    assert got[1][0] == 0 and got[0][0] == pytest.approx(-got[2][0]) == pytest.approx(math.log(1e-6 / (1 - 1e-6)))


# --- Indian scripts ---


@pytest.mark.parametrize("word, want", [("लिमिटेड", "limited"), ("प्राइवेट", "praivet"), ("कंपनी", "kampani"), ("ಕನ್ನಡ", "kannada"), ("தமிழ்", "tamil"), ("ਪੰਜਾਬ", "panjab"), ("१२", "12"), ("abc", "abc")])
def test_transliteration(word, want):
    got = indic.transliterate(word)
    assert got == want or cleaning.phonetic(got) == cleaning.phonetic(want)


def test_states_and_learned_words():
    assert "MH" in indic.to_latin("पुणे, महाराष्ट्र", states=True) and indic.to_latin("कंपनी", {"कंपनी": "company"}) == "company"


# --- names and addresses ---

PLAIN = cleaning.Cleaner()
WITH_WORDS = cleaning.Cleaner(vocab={"urban": 5, "lakshmi": 3, "services": 9})


@pytest.mark.parametrize(
    "raw, country, field, want",
    [
        ("Solmira DBA Eastern Mill", "", "name_core", "eastern mill"), ("Solmira DBA Eastern Mill", "", "name_had_alias", 1), ("Acme | www.acme.com", "", "name_core", "acme"),
        ("S K Enterprises Pvt. Ltd.", "India", "name_norm", "sk enterprises private limited"), ("Sapphire LLC Services", "us", "name_key", "sapphire"), ("Sapphire LLC Services", "us", "name_legal", "llc"),
        ("Gulf Prlvate Ltd", "", "name_legal", "limited private"), ("Pirate Pizza", "", "name_core", "pirate pizza"), ("Marina Ecole (France) Sarl", "France", "name_core", "marina ecole"), ("Marina Ecole France Sarl", "fr", "name_core", "marina ecole"),
        ("Dr. Mr. Smith", "", "name_core", "smith"), ("The LLC", "", "name_core", "llc"), ("", "", "name_core", ""), ("प्रा. लि.", "India", "name_was_indic", 1), ("First Bank", "", "name_core", "1 bank"), ("Alpha (ID: 37946)", "", "name_core", "alpha"),
    ],
)
def test_names(raw, country, field, want):
    assert PLAIN.name(raw, country)[field] == want


def test_site_names_are_split_by_known_words():
    assert WITH_WORDS.name("urbanlakshmiservices.com")["name_tokens"] == ["urban", "laxmi", "services"]
    assert WITH_WORDS.segment("urbanxyz") == ["urbanxyz"] and PLAIN.segment("urbanlakshmi") == ["urbanlakshmi"]


@pytest.mark.parametrize(
    "raw, country, want",
    [
        ("12a Main Street, San Jose CA 95113", "us", {"addr_house": "12", "addr_house_sfx": "a", "addr_postal": "95113", "addr_state": "ca", "addr_street": "main st"}),
        ("41 Avneue Foch, 75001 Paris, Ile de France", "France", {"addr_house": "41", "addr_street": "avenue foch", "addr_postal": "75001", "addr_state": "idf"}),
        ("Road 3, Kolkata 700 001, West Bengal", "India", {"addr_postal": "700001", "addr_state": "wb"}), ("7 ter rue X", "fr", {"addr_house": "7", "addr_house_sfx": "ter"}),
        ("4003-4007 Oak Avenue", "us", {"addr_house": "4003"}), ("Plot 5 Gandhi Nagar", "India", {"addr_house": "5"}), ("New York, New York", "us", {"addr_state": "ny", "addr_norm": "new york"}),
        ("<NULL>", "", {"addr_empty": 1}), ("PO Box 123, Austin TX", "us", {"addr_state": "tx", "addr_postal": ""}), ("12345 Main St", "us", {"addr_postal": "", "addr_house": "12345"}), ("Nice 06000", "fr", {"addr_postal": "06000"}),
    ],
)
def test_addresses(raw, country, want):
    got = PLAIN.address(raw, country)
    assert {k: got[k] for k in want} == want


def test_clean_records_has_all_fields_and_takes_nulls(spark):
    rows = [(1, "S1-1", "Acme Inc", "1 Main St", "us"), (2, "S2-1", None, None, None)]
    frame = spark.createDataFrame(rows, "src int, entity_id string, business_name string, business_address string, country string")
    got = {r["entity_id"]: r for r in cleaning.clean_records(frame).collect()}
    assert set(cleaning.FIELDS) <= set(got["S1-1"].asDict()) and got["S1-1"]["name_legal"] == "incorporated" and got["S2-1"]["addr_empty"] == 1
    assert cleaning.clean_records(frame.limit(0)).collect() == []


def test_tables_hold_what_they_should():
    assert len(tables.US_STATES) == 55 and len(tables.IN_STATES) == 39 and len(set(tables.FR_REGIONS.values())) == 13
    assert tables.ADDR_SHORT["ave"] == "avenue" and tables.NAME_SHORT["second"] == "2"


def test_long_subsequences_leave_out_far_places(monkeypatch):
    rng = random.Random(4)
    some = lambda n, letters: [rng.choice(letters) for _ in range(n)]
    monkeypatch.setattr(similarity, "_SHORT", 32)
    monkeypatch.setattr(similarity, "_STEP", 16)
    for k in range(120):
        letters = ["ab", "abcdefg ", "aé\U0001f600 \0"][k % 3]
        a = some(rng.randint(0, 200), letters)
        b = some(rng.randint(0, 300), letters + "z")
        if k % 2:
            b = list(a)
            for _ in range(rng.randint(0, 6)):
                i = rng.randint(0, len(b))
                b[i : i + rng.randint(0, 9)] = some(rng.randint(0, 30), letters)
        a, b = "".join(a), "".join(b)
        assert similarity.lcs(a, b) == similarity.lcs(b, a) == plain_lcs(a, b)
    monkeypatch.undo()
    places, met = [], similarity._met

    def counted(where, n, b, band=lambda i, j: (0, 1 << 30)):
        def seen(i, j):
            low, high = band(i, j)
            places.append((min(high, n) - max(low, 0)) * (j - i))
            return low, high

        return met(where, n, b, seen)

    monkeypatch.setattr(similarity, "_met", counted)
    a = "".join(some(20_000, "abcdefgh "))
    b = "x" + a[:7000] + "yyyyyyyyyy" + a[7000:]
    assert similarity.lcs(a, b) == 20_000 and sum(places) < 20_000 * 20_000 // 5  # all of them before


def test_words_are_classed_once():
    asked = []
    known = cleaning.Classes([("n", lambda w: asked.append(w) or w.isdigit())])
    assert cleaning.classes(["a", "1", "a", "1", "a"], known) == "wnwnw" and asked == ["a", "1"]  # five times before


def test_pairs_are_compared_in_the_jvm(spark):
    rng = random.Random(9)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    pairs = [(a, b) for a, b in itertools.product(["", " ", "a", "b a a", "a b", "é　\U0001f600 ﬀ", "ﬀ \U0001f600 é"], repeat=2)]
    for k in range(90):
        letters = ["ab ", "abcdefgh  ", "aé\U0001f600　ﬀ "][k % 3]
        a = some(rng.choice([3, 40, 300, 1500]), letters)
        at = rng.randint(0, len(a))
        pairs.append((a, a[:at] + some(rng.randint(0, 400), letters) + a[at + rng.randint(0, 90) :] if k % 2 else some(rng.choice([3, 40, 700, 1200]), letters)))
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    short = lambda kind, c: F.substring(c, 1, 60) if kind == "partial" else F.col(c)
    found = frame.select("i", *[similarity.pair_similarity(kind, short(kind, "a"), short(kind, "b")).alias(kind) for kind in similarity.KINDS])
    assert "Python" not in found._jdf.queryExecution().toString()
    for r in found.collect():
        a, b = pairs[r["i"]]
        for kind, core in similarity.KINDS.items():
            assert r[kind] == (core(a[:60], b[:60]) if kind == "partial" else core(a, b)), (kind, a, b)
