"""Record files: tab-separated sources and truth, repair of broken lines, id-list outputs and their checks."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ["entity_id", "business_name", "business_address", "country"]
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated source: all strings, no quoting, columns by name; missing values and columns are empty."""
    raw = spark.read.option("sep", "\t").option("quote", "").option("header", True).option("mode", "PERMISSIVE").csv(path)
    have = {c.strip().lstrip("﻿"): c for c in raw.columns}
    return raw.select(*[F.coalesce(F.col(f"`{have[c]}`"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in COLUMNS])


def read_sources(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """Sources by number, in one table with src."""
    out = None
    for k, path in sorted(paths.items()):
        one = read_source(spark, path).withColumn("src", F.lit(k).cast("tinyint"))
        out = one if out is None else out.unionByName(one)
    return out.select("src", *COLUMNS)


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(truth(s1_id, tgt_id), entities(s1_id)): lists of matches as rows, and every listed record, also without matches."""
    raw = spark.read.option("sep", "\t").option("quote", "").option("header", True).csv(path)
    lists = raw.select(F.trim("source1_entity_id").alias("s1_id"), F.split(F.coalesce("matched_entity_ids", F.lit("")), ",").alias("ids"))
    truth = lists.select("s1_id", F.explode("ids").alias("t")).select("s1_id", F.trim("t").alias("tgt_id")).where(F.length("tgt_id") > 0)
    return truth, lists.select("s1_id").distinct()


# --- repair ---


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of a text file; pos follows the order in the file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    return lines.select("file", F.struct("block", "id").alias("pos"), "line")


def glue_lines(lines: DataFrame, group: list[str], order: str, start: Column, line: str = "line", chunk: Column | None = None) -> DataFrame:
    """Lines from one start to the next, joined by blanks: gaps and islands within each group.

    A running count of starts numbers the records; lines before the first start are dropped.  chunk cuts a group into
    parts that follow each other in the order, such as the splits of a file: then a task counts within one chunk, and
    only the chunks' totals, a row each, are summed up over the group.
    """
    hit = F.when(start, 1).otherwise(0)
    if chunk is None:
        marked = lines.withColumn("rec", F.sum(hit).over(Window.partitionBy(*group).orderBy(order)))
    else:
        cut = lines.withColumn("__chunk", chunk)
        totals = cut.groupBy(*group, "__chunk").agg(F.sum(hit).alias("n"))
        earlier = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select(*group, "__chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
        local = F.sum(hit).over(Window.partitionBy(*group, "__chunk").orderBy(order))
        marked = cut.withColumn("rec", local).join(before, [*group, "__chunk"]).withColumn("rec", F.col("rec") + F.col("__before")).drop("__chunk", "__before")
    parts = marked.where(F.col("rec") > 0).groupBy(*group, "rec").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("t")))).alias("parts"))
    return parts.select(*group, "rec", F.array_join(F.transform("parts", lambda p: p["t"]), " ").alias("text"), F.size("parts").alias("n_lines"))


def repair_fields(text: Column, countries: list[str]) -> Column:
    """Four fields of a glued line: middle fields join the address, missing ones are empty, a country at the end of a third field is cut off."""
    # With F.trim itself, transform would pass each field's place as the character to trim.
    fields = F.transform(F.split(F.regexp_replace(text, "^﻿", ""), "\t"), lambda x: F.trim(x))
    tail = rf"(?i)[\s,]+({'|'.join(countries)})\s*$"
    n = F.size(fields)
    at = lambda i: F.coalesce(F.get(fields, F.lit(i)), F.lit(""))
    middle = F.array_join(F.filter(F.slice(fields, 3, F.greatest(n - 3, F.lit(0))), lambda x: x != ""), " ")
    many = F.array(at(0), at(1), middle, F.element_at(fields, -1))
    three = F.when(at(2).rlike(tail), F.array(at(0), at(1), F.regexp_replace(at(2), tail, ""), F.regexp_extract(at(2), tail, 1))).otherwise(F.array(at(0), at(1), at(2), F.lit("")))
    return F.when(n > 4, many).when(n == 4, fields).when(n == 3, three).otherwise(F.array(at(0), at(1), at(2), at(3)))


COUNTRY_NAMES = ("India", "US", "USA", "United States", "France")


def repair_lines(lines: DataFrame, source: int, countries: tuple[str, ...] = COUNTRY_NAMES) -> DataFrame:
    """Lines (file, pos, line) as records: glued, with four fields, header and blank lines gone, columns in the order of the file's header."""
    plain = lines.withColumn("line", F.regexp_replace(F.regexp_replace("line", "^\ufeff", ""), "\r$", "")).where(F.trim("line") != "")
    names = F.transform(F.split("line", "\t"), lambda x: F.trim(x))
    is_header = F.col("line").contains("entity_id") & F.col("line").contains("business_name")
    # A row for each file at most; a header that does not name the four columns counts for nothing.
    headers = plain.where(is_header).groupBy("file").agg(F.min_by(names, "pos").alias("order")).where(F.array_sort("order") == F.array(*map(F.lit, sorted(COLUMNS))))
    glued = glue_lines(plain.where(~is_header), ["file"], "pos", F.col("line").rlike("^S[123]-"), chunk=F.col("pos.block"))
    fields = glued.join(headers, "file", "left").select("file", "rec", "n_lines", F.coalesce("order", F.array(*map(F.lit, COLUMNS))).alias("order"), repair_fields(F.col("text"), list(countries)).alias("f"))
    at = lambda c: F.get("f", (F.array_position("order", c) - 1).cast("int"))
    return fields.select("file", "rec", "n_lines", *[at(c).alias(c) for c in COLUMNS], F.lit(source).cast("tinyint").alias("src"))


def repair_file(spark: SparkSession, path: str, source: int, countries: tuple[str, ...] = COUNTRY_NAMES) -> DataFrame:
    """A broken source file, or several under one path, as records."""
    return repair_lines(numbered_lines(spark, path), source, countries)


def first_by_id(*parts: DataFrame) -> DataFrame:
    """Union of repaired files, of an id the first row: by file's place in the arguments, then by record."""
    out = None
    for k, p in enumerate(parts):
        one = p.withColumn("file_no", F.lit(k))
        out = one if out is None else out.unionByName(one)
    rn = F.row_number().over(Window.partitionBy("entity_id").orderBy("file_no", "rec"))
    return out.withColumn("rn", rn).where("rn = 1").drop("rn", "file_no")


def repair_report(repaired: DataFrame, source: int) -> DataFrame:
    return repaired.agg(F.count("*").alias("rows"), F.sum((F.col("n_lines") > 1).cast("int")).alias("glued"), F.sum((~F.col("entity_id").startswith(f"S{source}-")).cast("int")).alias("wrong_prefix"), F.sum((F.col("country") == "").cast("int")).alias("no_country"))


def missing_ids(truth: DataFrame, records: DataFrame) -> DataFrame:
    """Ids of the truth that no record has."""
    ids = truth.select(F.col("s1_id").alias("entity_id")).unionByName(truth.select(F.col("tgt_id").alias("entity_id"))).distinct()
    return ids.join(records.select("entity_id"), "entity_id", "left_anti")


def clean_field(c: Column) -> Column:
    return F.translate(c, "\t\n\r", "   ")


# --- outputs ---


def id_lists(entities: DataFrame, pairs: DataFrame, name: str = "matched_entity_ids", in_order: bool = False) -> DataFrame:
    """A row for each of entities(s1_id) with its pairs' ids sorted and joined; empty without any.

    in_order: as the ids come in entities first, such as the lines of a file.
    """
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("tgt_id")), ",").alias(name))
    own = entities.select("s1_id", F.monotonically_increasing_id().alias("pos")).groupBy("s1_id").agg(F.min("pos").alias("pos")) if in_order else entities.select("s1_id").distinct()
    met = own.join(lists, "s1_id", "left")
    return (met.orderBy("pos") if in_order else met).select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def empty_share(lists: DataFrame, records: DataFrame, column: str = "country", name: str = "matched_entity_ids") -> DataFrame:
    """(country, n, empty): the share of records without any id in their list, by a column of their record."""
    land = records.where("src = 1").select(F.col("entity_id").alias("source1_entity_id"), column)
    return lists.join(land, "source1_entity_id", "left").groupBy(column).agg(F.count("*").alias("n"), F.avg((F.col(name) == "").cast("double")).alias("empty"))


def write_table(df: DataFrame, path: str) -> None:
    """Tab-separated with a header, arrays joined, in parts; never in place."""
    flat = [F.array_join(c, " | ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).select(*[clean_field(F.col(c).cast("string")).alias(c) for c in df.columns]).write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def validate(lists: DataFrame, entities: DataFrame, targets: DataFrame, candidates: DataFrame | None = None, name: str = "matched_entity_ids") -> dict[str, int]:
    """Faults of an id list: rows twice, records missing or unknown, ids twice in a row or unknown, matches that are no candidates."""
    own = lists.select(F.col("source1_entity_id").alias("s1_id"), F.filter(F.split(name, ","), lambda x: x != "").alias("ids"))
    each = own.select("s1_id", F.explode("ids").alias("tgt_id"))
    known = targets.select(F.col("entity_id").alias("tgt_id"))
    found = {
        "rows_twice": own.groupBy("s1_id").count().where("count > 1").count(),
        "missing": entities.select("s1_id").join(own, "s1_id", "left_anti").count(),
        "unknown": own.join(entities.select("s1_id"), "s1_id", "left_anti").count(),
        "ids_twice": own.where(F.size("ids") != F.size(F.array_distinct("ids"))).count(),
        "unknown_ids": each.join(known, "tgt_id", "left_anti").count(),
    }
    if candidates is not None:
        found["not_candidates"] = each.join(candidates.select("s1_id", "tgt_id"), ["s1_id", "tgt_id"], "left_anti").count()
    return found




# --- files of one folder, through the session's file system ---


def _paths(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _paths(spark, path)
    return bool(fs.exists(p))


def find_half(spark: SparkSession, folder: str, source: int) -> str | None:
    """The one .tsv file of a folder with `half` and the source's number in its name; none if there are several."""
    p, fs = _paths(spark, f"{folder.rstrip('/')}/*.tsv")
    hits = [s.getPath() for s in fs.globStatus(p) or [] if "half" in s.getPath().getName().lower() and str(source) in s.getPath().getName()]
    return hits[0].toString() if len(hits) == 1 else None


def replace_file(spark: SparkSession, df: DataFrame, path: str) -> str:
    """df in the place of path, which is kept as <path>.orig the first time; written beside it, then renamed."""
    old, fs = _paths(spark, path)
    kept, fresh = _paths(spark, f"{path}.orig")[0], _paths(spark, f"{path}.new")[0]
    fs.delete(fresh, True)
    write_table(df, f"{path}.new")
    if fs.exists(kept):
        fs.delete(old, True)
    elif not fs.rename(old, kept):
        raise OSError(f"cannot keep {path}")
    if not fs.rename(fresh, old):
        raise OSError(f"cannot replace {path}")
    return kept.toString()


def pack(spark: SparkSession, tables: dict[str, str], out: str) -> None:
    """A zip file of tables written by write_table, each as one file with one header; bytes go through in small pieces."""
    import io
    import zipfile

    missing = [p for p in tables.values() if not exists(spark, f"{p}/_SUCCESS")]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, path in tables.items():
            columns = spark.read.option("sep", "\t").option("quote", "").option("header", True).csv(path).columns
            with z.open(f"output/{name}.tsv", "w", force_zip64=True) as raw, io.TextIOWrapper(raw, "utf-8", newline="") as f:
                f.write("\t".join(columns) + "\n")
                for (line,) in spark.read.text(f"{path}/part-*").where(F.col("value") != "\t".join(columns)).toLocalIterator():
                    f.write(line + "\n")
