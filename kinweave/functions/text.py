"""String functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables


def _folding() -> tuple[str, str]:
    """Accented Latin letters and their plain ones, from the Unicode decompositions."""
    pairs = dict(tables.QUOTES)
    for cp in range(0xC0, 0x250):
        plain = unicodedata.normalize("NFKD", chr(cp)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            pairs[chr(cp)] = plain
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _folding()


def ascii_fold(s: Column) -> Column:
    """Plain letters for accented ones; what has none is dropped."""
    for a, b in tables.LIGATURES.items():
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(s, _FROM, _TO), r"[^\x00-\x7F]+", "")


def base_clean(s: Column) -> Column:
    """Lower-case words of letters and digits, with / and - inside; null gives an empty string."""
    s = F.lower(ascii_fold(F.coalesce(s, F.lit(""))))
    s = F.regexp_replace(s, "[&+]", " and ")
    # Initials with dots become one word: a mark is put where dots and blanks between single letters stood.
    s = F.regexp_replace(s, r"(?<=\b[a-z])\.\s?(?=[a-z]\.)|(?<=\b[a-z])\.(?=[a-z]\b)", "")
    s = F.regexp_replace(s, r"(?<=\b[a-z]{2,9})\.(?=\s|$)", " ")
    s = F.regexp_replace(s, r"\b[dl]'(?=[a-z])", "")
    s = F.regexp_replace(s, "'", "")
    s = F.regexp_replace(s, r"(?<=[a-z]{2})-(?=\d)", " ")
    s = F.regexp_replace(s, r"(?<=\b[a-z])-(?=\d)", "")
    s = F.regexp_replace(s, r"(?<=[a-z])-(?=[a-z])|(?<=\d)-(?=[a-z]{2})", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9/\- ]+", " "), r"\s+", " "))


def tokens(clean: Column) -> Column:
    """Words of a cleaned string; / and - stay only in words with a digit."""
    parts = F.transform(F.split(clean, " "), lambda t: F.regexp_replace(t, r"^[/-]+|[/-]+$", ""))
    split = F.flatten(F.transform(parts, lambda t: F.when(t.rlike("[0-9]"), F.array(t)).otherwise(F.split(t, "[/-]+"))))
    return F.filter(split, lambda t: t != "")


def lookup(mapping: Mapping[str, str], key: Column) -> Column:
    """mapping[key], or key."""
    table = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])
    return F.coalesce(F.try_element_at(table, key), key)


def one_of(values: Iterable[str], s: Column) -> Column:
    return s.isin(*sorted(values))


def normalize_country(s: Column) -> Column:
    words = F.trim(F.regexp_replace(F.replace(base_clean(s), F.lit("-"), F.lit(" ")), r"\s+", " "))
    return F.replace(lookup(tables.COUNTRY_OF, words), F.lit(" "), F.lit("_"))


def collapse_repeats(s: Column) -> Column:
    return F.regexp_replace(s, r"(.)\1+", "$1")


def phonetic_key(s: Column) -> Column:
    """First letter and consonants by sound: spellings of a word by ear share it."""
    s = F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z]", "")
    for a, b in tables.PHONETIC:
        s = F.replace(s, F.lit(a), F.lit(b))
    return collapse_repeats(F.concat(F.substring(s, 1, 1), F.regexp_replace(F.substring(s, 2, 1 << 20), "[aeiouy]", "")))


def skeleton(s: Column) -> Column:
    """First character and consonants, repeats as one, five at most."""
    body = F.regexp_replace(F.substring(s, 2, 1 << 20), "[aeiouhwy0-9]", "")
    return F.substring(collapse_repeats(F.concat(F.substring(s, 1, 1), body)), 1, 5)


def key_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 if a side is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def strip_ordinal(t: Column) -> Column:
    return F.regexp_replace(t, r"^(\d+)(?:st|nd|rd|th|er|re|eme|e|ere)$", "$1")


def repair_digits(t: Column, tail: bool) -> Column:
    """Digits that stand for letters inside a word: gu1f -> gulf; at the end only if tail."""
    fixed = t
    for d, letter in tables.LOOKALIKE_DIGITS.items():
        fixed = F.regexp_replace(fixed, rf"(?<=[a-z]){d}(?=[a-z])", letter)
    for d, letter in tables.LOOKALIKE_DIGITS.items():
        fixed = F.regexp_replace(fixed, rf"^{d}(?=[a-z]{{2}})", letter)
    if tail:
        for d, letter in tables.LOOKALIKE_DIGITS.items():
            fixed = F.regexp_replace(fixed, rf"(?<=[a-z]{{2}}){d}$", letter)
    mixed = t.rlike("^[a-z01568]+$") & t.rlike("[a-z]") & t.rlike("[0-9]") & ~t.rlike("[0-9]{2}")
    return F.when(mixed & (strip_ordinal(t) == t), fixed).otherwise(t)


def split_doubled(t: Column) -> Column:
    """llcllc -> llc, for words of the name tables."""
    half = F.regexp_extract(t, r"^(.{2,})\1$", 1)
    return F.when(one_of(tables.LEGAL | tables.NAME_SHORT.keys(), half), half).otherwise(t)


def unglue(t: Column) -> Column:
    """lecole -> ecole, for listed words."""
    rest = F.substring(t, 2, 1 << 20)
    return F.when(t.rlike("^[ld].{4,}") & one_of(tables.ELIDED, rest), rest).otherwise(t)


def is_abbreviation(short: Column, long: Column) -> Column:
    """short begins as long does and its letters stand in long, in order."""
    pattern = F.concat(F.lit("^"), F.array_join(F.split(short, ""), ".*"))
    shape = (F.length(short) >= 2) & (F.length(short) < F.length(long)) & short.rlike("^[a-z]+$") & long.rlike("^[a-z]+$")
    return F.when(shape, F.call_function("rlike", long, pattern)).otherwise(F.lit(False))


def merge_single_letters(joined: Column) -> Column:
    """`l l c` -> `llc` in a string of words."""
    return F.regexp_replace(joined, r"(?<=(?:^| )[a-z]) (?=[a-z](?: |$))", "")


def drop_consecutive(words: Column) -> Column:
    return F.filter(words, lambda t, i: (i == 0) | (t != F.get(words, i - 1)))


def has_indic(s: Column) -> Column:
    return s.rlike("[ऀ-ൿ]")


def digits_only(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def first_field(line: Column) -> Column:
    """What stands before the first tab, trimmed."""
    return F.trim(F.split_part(line, F.lit("\t"), F.lit(1)))


def percent(share: Column) -> Column:
    """A share as a percentage with two decimals, six places wide before the sign."""
    return F.concat(F.lpad(F.format_string("%.2f", 100 * share.cast("double")), 6, " "), F.lit("%"))
