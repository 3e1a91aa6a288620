"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Each item is cut into windows of `size` words; a window is a set of word shingles.  Shingles are ordered by
rarity, counted over all documents.  A document that contains a window contains its rarest shingle, so that
one is the window's necessary prefix: only prefixes are joined.  A hit at a place gives the window's only
possible start, which must lie inside the document; there the window's words are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .native import ascii_words, let, shingle_hashes

SHINGLE = 3
#: Shingles of all items that are broadcast at most (with a window's words, some 200 bytes each); places that windows may stand
#: at (as many bytes); ids of documents with such places (8 bytes).  More are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_PLACES, BROADCAST_IDS = 200_000, 20_000, 2_000_000


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """Distinct windows: (wtext, k, len, shingles, items): its words, shingle length and hashes, and ids of its items."""
    spans = lambda w: F.when(F.size(w) < size, F.array(w)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.slice(w, i, size))
    )
    cut = items.select(F.col("item_id").cast("string").alias("item"), F.explode_outer(let(ascii_words(F.col("text")), spans)).alias("w")).where("size(w) > 0")
    owned = cut.groupBy(F.array_join("w", " ").alias("wtext")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    words = F.split("wtext", " ")
    hashes = let(words, lambda w: F.when(F.size(w) == 1, shingle_hashes(w, 1)).when(F.size(w) == 2, shingle_hashes(w, 2)).otherwise(shingle_hashes(w, SHINGLE)))
    return owned.select("wtext", "items", F.size(words).alias("len"), F.least(F.size(words), F.lit(SHINGLE)).alias("k"), hashes.alias("shingles"))


def doc_shingles(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, n, pos, h): all shingles of all documents of the lengths asked for."""
    parts = []
    for k in lengths:
        pair = let(ascii_words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), shingle_hashes(w, k).alias("h")))
        one = docs.select("doc_id", pair.alias("x"))
        # The outer form, as the inner one gets a filter into which the optimizer copies all that is above.
        parts.append(one.select("doc_id", F.col("x.n").alias("n"), F.posexplode_outer("x.h").alias("pos", "h")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def candidates(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, cands): where windows may stand in each document, by their prefixes."""
    lengths = sorted(r[0] for r in windows.select("k").distinct().collect()) or [SHINGLE]
    shingles = windows.select(F.explode("shingles").alias("h")).distinct()
    few = windows.agg(F.sum(F.size("shingles"))).first()[0] or 0
    small = (lambda df: F.broadcast(df)) if few <= BROADCAST_ROWS else (lambda df: df)
    # One pass over the texts: every place of every shingle that some item has, for counts and candidates alike.
    rows = materialise(doc_shingles(docs, lengths).join(small(shingles), "h"))
    often = materialise(rows.groupBy("h").agg(F.count("*").alias("n_docs")))
    placed = windows.select("wtext", "len", "items", F.posexplode("shingles").alias("off", "h")).join(small(often), "h", "left")
    prefix = placed.groupBy("wtext").agg(F.min_by(F.struct("h", "off", "len", "items"), F.struct(F.coalesce("n_docs", F.lit(0)), F.col("h"), F.col("off"))).alias("p"))
    prefix = materialise(prefix.select("p.h", "p.off", "p.len", "p.items", "wtext"))
    met = rows.join(small(prefix), "h").withColumn("start", F.col("pos") - F.col("off"))
    inside = met.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
    # A window is looked for once at a place, however many rows of one doc_id have it there.
    return inside.groupBy("doc_id").agg(F.collect_set(F.struct("start", "len", "wtext", "items")).alias("cands"))


def _outcome(w: Column, cands: Column) -> Column:
    found = F.filter(cands, lambda c: F.array_join(F.slice(w, c["start"] + 1, c["len"]), " ") == c["wtext"])
    hit = lambda v: F.array_distinct(F.flatten(F.transform(v, lambda c: F.sequence(c["start"], c["start"] + c["len"] - 1))))
    items = lambda v: F.array_sort(F.array_distinct(F.flatten(F.transform(v, lambda c: c["items"]))))
    return let(found, lambda v: F.struct(F.size(w).cast("long").alias("n_words"), F.size(hit(v)).cast("long").alias("n_hit"), items(v).alias("items")))


def contaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """docs with n_words, n_hit and items (ids, as sorted strings) in a struct `leak`.

    docs has doc_id and text, items has item_id and text.  A document word is hit if it lies in an occurrence
    of `size` consecutive words of an item; an item of fewer words, but not none, is one window.  Null text has no
    words; no items: no hits.  Repeated rows of documents count each; repeated items name one item.  All columns
    of docs are kept; a column named leak is replaced.
    """
    docs = docs.drop("leak")
    windows = materialise(item_windows(items, size))
    cands = materialise(candidates(docs, windows).withColumnRenamed("doc_id", "__cand_doc"))
    many = cands.agg(F.count("*").alias("ids"), F.sum(F.size("cands")).alias("places")).first()
    none = F.array().cast(cands.schema["cands"].dataType)
    same = lambda c: docs["doc_id"].eqNullSafe(c["__cand_doc"])
    leak = lambda found: let(ascii_words(F.col("text")), lambda w: _outcome(w, found)).alias("leak")
    if many["ids"] <= BROADCAST_IDS and (many["places"] or 0) > BROADCAST_PLACES:
        # Only the texts with such places move; the others are known to be clean.
        ids = F.broadcast(cands.select("__cand_doc"))
        some = docs.join(ids, same(ids), "left_semi").join(cands, F.col("doc_id").eqNullSafe(F.col("__cand_doc"))).select(*docs.columns, leak(F.col("cands")))
        return docs.join(ids, same(ids), "left_anti").select(*docs.columns, leak(none)).unionByName(some)
    cands = F.broadcast(cands) if (many["places"] or 0) <= BROADCAST_PLACES else cands
    return docs.join(cands, same(cands), "left").select(*docs.columns, leak(F.coalesce("cands", none)))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from contaminated()."""
    return found.select(
        "doc_id",
        "leak.n_words",
        "leak.n_hit",
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
bw AS (
  SELECT item_id, CASE WHEN len(w) < 10 THEN w ELSE w[i:i + 9] END AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
win AS (SELECT DISTINCT item_id, array_to_string(g, ' ') AS g, len(g) AS n FROM bw),
lens AS (SELECT DISTINCT n FROM win),
place AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM place p JOIN win USING (g)),
pos AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
