"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are what fixed expressions find: addresses, IP numbers, card numbers, phone numbers.  The words beside a
seed are its lexical patterns.  Other identifier-like strings have such patterns too; together they form a
graph of patterns and instances with an edge for each occurrence.  A pattern scores, for each kind, the share of
its occurrences that belong to the kind's instances, discounted when it is rare, and patterns below CONFIDENT are not
used.  An instance scores the mean of its occurrences' patterns, or of the better word of each occurrence if that is
more.  After ROUNDS of this, instances above ACCEPT are found, wherever they stand.

The graph holds aggregated edges only; sums over a frequent pattern are combined on the map side.  Work on one text
grows little faster than its length, whatever runs of signs or numbers of spans it has: expressions try a run of
characters once, positions come from sums in two levels, and no span is held against all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .native import LOWER, UPPER, let

# The seed expressions.  Possessive and bounded forms find the same as plain ones, in linear time:
# a local part is tried only where it can begin, and runs of under 13 digits are never card numbers.
LOCAL = r"[A-Za-z0-9._%+-]"
SEEDS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a seed of the kind.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: An identifier-like string: groups of digits with single blanks between them, or what begins and ends with a letter or digit
#: and has a digit or an at sign.  Context, not length, tells identifiers from other numbers.  A run of characters is tried where it
#: begins only; signs that it begins with are cut off later.
SIGNS = "@._:/#-"
GROUP = rf"(?:\([0-9]++\)|[0-9]++(?:-[0-9]++)*+)(?![{SIGNS}]*+[A-Za-z0-9])"
THING = (
    rf"(?<![A-Za-z0-9])(?:\([0-9]++\)\x20?+|[0-9]++\x20){GROUP}(?:\x20{GROUP})*+"
    rf"|(?<![A-Za-z0-9{SIGNS}])[{SIGNS}]*+(?=[A-Za-z{SIGNS}]*+[0-9]|[A-Za-z0-9._:/#-]++@)[A-Za-z0-9][A-Za-z0-9{SIGNS}]*(?<=[A-Za-z0-9])"
)
#: Rounds of scoring, the score from which an instance is found, the score from which a pattern is used, and the occurrences
#: by which a pattern's score is discounted.
ROUNDS, ACCEPT, CONFIDENT, DISCOUNT = 3, 0.6, 0.25, 4.0
KINDS = list(SEEDS)
CONTEXT_CHARS = 32
#: Documents with added spans that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 50_000


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum: from the right, every second digit doubled."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(let(c.cast("int") * 2, lambda d: d - F.when(d > 9, 9).otherwise(0))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return let(digits(s), lambda d: F.length(d).between(13, 19) & luhn(d))
    if kind == "phone":
        return F.length(digits(s)).between(9, 15)
    return F.lit(True)


def running(values: Column, first: int, merge) -> Column:  # noqa: ANN001
    """For each place of an array of numbers, merge() of all up to it; in two levels, as appending copies what there is."""

    def walk(part: Column, begin: Column) -> Column:
        return F.aggregate(part, F.array(begin), lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), x))))

    def each(v: Column) -> Column:
        step = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"))
        return let(step, lambda k: let(F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / k).cast("int")), lambda i: F.slice(v, i * k + 1, k)), blocks))

    def blocks(parts: Column) -> Column:
        starts = walk(F.transform(parts, lambda c: F.aggregate(c, F.lit(first), lambda a, x: merge(a, x))), F.lit(first))
        return let(starts, lambda at: F.flatten(F.transform(parts, lambda c, i: F.slice(walk(c, at[i]), 2, F.size(c)))))

    return let(values, lambda v: F.when(F.size(v) > 0, each(v)).otherwise(F.array().cast("array<int>")))


def places(text: Column, pattern: str, needs: str) -> Column:
    """(start, end, value, before, after) of each match, in code points, with up to CONTEXT_CHARS characters on either side.

    Positions are sums of the lengths of the matches and of what lies between; what lies beyond the next match is not looked at.
    """
    spot = "array<struct<start:int,end:int,value:string,before:string,after:string>>"

    def walk(found: Column, between: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.length(m) + F.length(between[i]))
        near = lambda x: F.coalesce(x, F.lit(""))
        before = lambda i: F.right(F.concat(near(F.get(found, i - 1)), between[i]), F.lit(CONTEXT_CHARS))
        after = lambda i: F.left(F.concat(between[i + 1], near(F.get(found, i + 1))), F.lit(CONTEXT_CHARS))
        one = lambda m, i, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("value"), before(i).alias("before"), after(i).alias("after"))
        return let(running(sizes, 0, lambda a, x: a + x), lambda ends: F.transform(found, lambda m, i: one(m, i, ends[i])))

    hit = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda b: walk(m, b)))
    return F.when(text.rlike(needs), hit).otherwise(F.array().cast(spot))


def _marked(spans: Column, kind: Column) -> Column:
    return F.transform(spans, lambda p: F.struct(kind.alias("kind"), *[p[c].alias(c) for c in ("start", "end", "value", "before", "after")]))


def seed_spans(text: Column) -> Column:
    """(kind, start, end, value, before, after) of the seeds, by kind as listed, then start."""
    checked = lambda kind, pattern: F.filter(places(text, pattern, NEEDS[kind]), lambda p: valid(kind, p["value"]))
    return F.concat(*[_marked(checked(k, rx), F.lit(k)) for k, rx in SEEDS.items()])


def _apart(things: Column, seeds: Column) -> Column:
    """The things that overlap no seed: of seeds that start before a thing's end, the furthest end is not beyond its start."""
    event = lambda at, seed, to, i: F.struct(at.alias("at"), F.lit(seed).alias("seed"), to.alias("to"), i.alias("i"))
    events = F.array_sort(F.concat(F.transform(seeds, lambda s: event(s["start"], 1, s["end"], F.lit(-1))), F.transform(things, lambda p, i: event(p["end"], 0, p["start"], i))))

    def walk(e: Column) -> Column:
        reach = running(F.transform(e, lambda x: F.when(x["seed"] == 1, x["to"]).otherwise(-1)), -1, lambda a, x: F.greatest(a, x))
        free = F.zip_with(e, reach, lambda x, r: F.when((x["seed"] == 0) & (r <= x["to"]), x["i"]))
        return F.transform(F.filter(free, lambda i: i.isNotNull()), lambda i: things[i])

    return F.when((F.size(seeds) == 0) | (F.size(things) == 0), things).otherwise(let(events, walk))


def _things(text: Column, seeds: Column) -> Column:
    """Identifier-like strings outside the seeds, with a null kind."""
    bare = lambda p: F.ltrim(p["value"], F.lit(SIGNS))
    cut = F.transform(places(text, THING, "[0-9@]"), lambda p: let(bare(p), lambda v: F.struct((p["end"] - F.length(v)).alias("start"), p["end"].alias("end"), v.alias("value"), p["before"].alias("before"), p["after"].alias("after"))))
    return let(cut, lambda t: _marked(_apart(t, seeds), F.lit(None).cast("string")))


def _in_context(spans: Column) -> Column:
    """The spans with the words beside them: the lexical patterns."""
    plain = lambda s: F.regexp_replace(F.translate(s, UPPER, LOWER), "[0-9]+", "0")
    left = lambda s: F.regexp_extract(s["before"], r"(\S++)[\s\"'(<]*+$", 1)
    right = lambda s: F.regexp_extract(s["after"], r"^[\s\"')>,;]*+(\S+)", 1)
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.translate(s["value"], UPPER, LOWER).alias("value"), F.concat(F.lit("L "), plain(left(s))).alias("left"), F.concat(F.lit("R "), plain(right(s))).alias("right")))


def occurrences(docs: DataFrame) -> DataFrame:
    """docs' key, and base and others: seeds and other identifier-like strings with their patterns."""
    text = F.coalesce("text", F.lit(""))
    both = lambda t: let(seed_spans(t), lambda s: F.struct(_in_context(s).alias("base"), _in_context(_things(t, s)).alias("others")))
    some = F.coalesce("text", F.lit("")).rlike("[0-9@]")
    # Texts without a digit or an at sign have neither.
    found = F.when(some, let(text, both))
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), found.alias("x")).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "mark", "x.base", "x.others")


def discover(seen: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT, discount: float = DISCOUNT, confident: float = CONFIDENT) -> DataFrame:
    """seen(rid, base, others) -> (rid, kind, start, end) of the instances found by context."""
    span = F.explode(F.concat("base", "others")).alias("s")
    each = seen.where("base IS NOT NULL").select(span).select("s.kind", "s.value", "s.left", "s.right")
    # A pattern without a word says nothing.
    told = each.where((F.length("left") > 2) | (F.length("right") > 2)).groupBy("left", "right", "value").agg(F.count("*").alias("n"), F.max("kind").alias("kind"))
    told = materialise(told.select(F.monotonically_increasing_id().alias("oid"), "*"))
    sides = told.select("oid", "value", "n", "kind", F.explode(F.array("left", "right")).alias("pattern")).where(F.length("pattern") > 2)
    edges = materialise(sides.groupBy("pattern", "value").agg(F.sum("n").alias("n"), F.max("kind").alias("kind")))
    seeds = edges.where("kind IS NOT NULL").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    weight = edges.groupBy("pattern").agg(F.sum("n").alias("all"), F.count("*").alias("values"))
    unseen = told.where("kind IS NULL").select("oid", "value", "n", (F.length("left") > 2).cast("int").alias("l"), (F.length("right") > 2).cast("int").alias("r"))
    total = unseen.groupBy("value").agg(F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("l") + F.col("r"))).alias("sides"))
    scores = seeds
    for _ in range(rounds):
        held = edges.select("pattern", "value", "n").join(scores, "value").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("own"), F.sum("score").alias("each"))
        # Alone, a pattern counts by distinct values, as copies of one document are no support, and only as a word: an
        # identifier beside another does not tell its kind.
        alone = F.when(~F.col("pattern").rlike("[0-9@]"), F.col("each") / (F.col("values") + discount)).otherwise(0.0)
        scored = held.join(weight, "pattern").select("pattern", F.col("kind").alias("as"), (F.col("own") / (F.col("all") + discount)).alias("p"), alone.alias("alone"))
        patterns = materialise(scored.where(F.greatest("p", "alone") >= confident))
        met = sides.where("kind IS NULL").join(patterns, "pattern").groupBy("oid", "value", "n", "as").agg(F.sum("p").alias("p"), F.max("alone").alias("alone"))
        given = met.groupBy("value", "as").agg(F.sum(F.col("n") * F.col("p")).alias("mean"), F.sum(F.col("n") * F.greatest("alone", F.col("p") / 2)).alias("best"))
        grown = given.join(total, "value").select("value", F.col("as").alias("kind"), F.greatest(F.col("mean") / F.col("sides"), F.col("best") / F.col("all")).alias("score")).join(seeds.select("value"), "value", "left_anti")
        new = materialise(seeds.unionByName(grown))
        if scores is not seeds:
            discard(scores)
        scores = new
    best = scores.where((F.col("score") >= accept) & (F.col("score") < 1)).groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    spots = seen.where("base IS NOT NULL").select("rid", F.explode("others").alias("s")).select("rid", "s.value", "s.start", "s.end")
    return spots.join(best, "value").select("rid", "kind", "start", "end")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, end), by kind as listed and start; a row for each row of docs.

    Null text is empty.  Positions are code points, ends exclusive.  Spans of one kind don't overlap; spans of two
    kinds may.  Added spans never overlap seeds.  Repeated rows count each, and their occurrences too; other
    columns are ignored; an empty table gives an empty result.
    """
    seen = materialise(occurrences(docs))
    added = discover(seen).groupBy("rid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    kind = "array<struct<kind:string,start:int,end:int>>"
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast(kind)
    return seen.join(added, "rid", "left").select("doc_id", F.coalesce(base, none).alias("base"), F.coalesce("added", none).alias("added"))


#: Characters of a piece that a text is cut into for redaction; taking part of a string walks it from its beginning.
PIECE = 4096


def _cut(text: Column, spans: Column) -> Column:
    """text with each span, or group of overlapping ones, replaced by the first one's kind in brackets."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    size = F.length(text)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / PIECE).cast("int")), lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE)))

    def between(parts: Column, a: Column, b: Column) -> Column:
        piece = lambda c: let(F.greatest(a - c * PIECE, F.lit(0)), lambda x: F.substring(parts[c], x + 1, F.least(b - c * PIECE, F.lit(PIECE)) - x))
        numbers = F.sequence(F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int"))
        return F.when(b > a, F.array_join(F.transform(numbers, piece), "")).otherwise("")

    def walk(parts: Column, spans: Column, reach: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
        done = F.transform(spans, lambda s, i: let(before(i), lambda p: F.when(s["start"] >= p, F.concat(between(parts, p, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")))
        return F.concat(F.array_join(done, ""), let(size, lambda n: between(parts, F.element_at(reach, -1), n)))

    ends = lambda o: running(F.transform(o, lambda s: s["end"]), 0, lambda a, x: F.greatest(a, x))
    done = let(by_start, lambda o: let(pieces, lambda parts: let(ends(o), lambda reach: walk(parts, o, reach))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every found span of text replaced by its kind in brackets; null text stays null."""
    seen = materialise(occurrences(docs))
    added = materialise(discover(seen).join(seen.select("rid", "doc_id", "mark"), "rid").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("kind", "start", "end")).alias("__added")))
    few = added.count() <= BROADCAST_ROWS
    met = added.select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark"), "__added")
    met = F.broadcast(met) if few else met
    both = docs.join(met, docs["doc_id"].eqNullSafe(met["__doc"]) & (F.xxhash64(docs["text"]) == met["__mark"]), "left")
    plain = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    more = F.coalesce("__added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    text = let(F.col("text"), lambda t: let(F.concat(plain(seed_spans(t)), more), lambda s: _cut(t, s)))
    return both.withColumn("text", F.when(F.col("text").rlike("[0-9@]"), text).otherwise(F.col("text"))).select(*docs.columns)


def _line(spans: Column) -> Column:
    order = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_line(F.col("base")), 256).alias("base_sha256"), _line(F.concat("base", "added")).alias("spans"))
