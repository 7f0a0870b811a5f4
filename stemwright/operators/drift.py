"""Schemas that drift between files: one table, one set of types, and a list of every change.

Raw lines become (file, job, path, raw type, text) rows on the JVM side with VARIANT, parsed and written once; everything
after that works on aggregates per file and field. No step holds a file or a job in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from stemwright.session import cut
from stemwright.sources.readers import one_object

FILE = ["run", "file_name"]


def _kind(raw: Column) -> Column:
    return (
        F.when(raw == "STRING", "string").when(raw == "BOOLEAN", "boolean").when(raw.startswith("ARRAY"), "array")
        .when(raw.startswith("OBJECT"), "object").when(raw == "VOID", None).otherwise("number")
    )


def parsed_lines(lines: DataFrame) -> DataFrame:
    """The JSON lines, written once: line_id, run, file_name, written_at, line_no, job and fields, an array of (field_name, kind, text).

    fields holds each value other than null with its raw type and its raw text. A line counts only if it is one
    JSON object; broken, empty and NULL lines are left out. A repeated key keeps its last value.
    """
    texts = F.map_entries(F.from_json("record", "map<string,string>"))
    kinds = F.map_values(F.from_json("record", "map<string,variant>"))
    rows = lines.filter(one_object(F.col("record"))).select("line_id", *FILE, "written_at", "line_no", texts.alias("t"), kinds.alias("v"))
    named = F.transform("t", lambda e, i: F.struct(e["key"].alias("field_name"), _kind(F.schema_of_variant(F.get("v", i))).alias("kind"), e["value"].alias("text")))
    last = F.filter("f", lambda e, i: F.array_max(F.transform("f", lambda x, k: F.when(x["field_name"] == e["field_name"], k))) == i)
    fields = F.when(F.size(F.array_distinct(F.transform("f", lambda e: e["field_name"]))) == F.size("f"), F.col("f")).otherwise(last)
    kept = rows.withColumn("f", named).withColumn("f", fields).withColumn("fields", F.filter("f", lambda e: e["kind"].isNotNull()))
    job = F.get(F.filter("fields", lambda e: e["field_name"] == "job_id"), F.lit(0))["text"]
    return cut(kept.select("line_id", *FILE, "written_at", "line_no", F.lower(F.trim(job)).alias("job"), "fields"), "drift-lines")


def path_values(parsed: DataFrame) -> DataFrame:
    """One row per line and field with a value other than null: its raw type and its text."""
    return parsed.select("line_id", *FILE, "written_at", "line_no", "job", F.inline("fields"))


def file_order(lines: DataFrame) -> DataFrame:
    """Files of each run numbered by written_at (ties by name), with the file before."""
    files = lines.groupBy(*FILE).agg(F.min("written_at").alias("written_at"))
    w = W.partitionBy("run").orderBy("written_at", "file_name")
    return files.withColumn("seq", F.row_number().over(w)).withColumn("prev_file", F.lag("file_name").over(w))


def path_stats(values: DataFrame) -> DataFrame:
    """Per file and field: rows with a value and the sorted raw types."""
    by_kind = values.groupBy(*FILE, "field_name", "kind").agg(F.count("*").alias("n"))
    return by_kind.groupBy(*FILE, "field_name").agg(
        F.sum("n").alias("n_values"), F.array_sort(F.collect_set("kind")).alias("kinds")
    )


def schema_changes(lines: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Changes of each file against the one before it in its run, with the support of each rename.

    renamed: over the jobs in both files the gone and the new field hold the same texts (the first by
    line number where a job's lines differ), none where the other has none. Both fields are compared
    by count and two 64-bit sums over (job, text), so gone and new fields meet in an equi-join.
    Edge cases: a file without a JSON line has no fields; jobs are compared trimmed and in lower
    case; lines without job_id take no part in renames; an empty table gives no rows.
    """
    parsed = parsed_lines(lines) if parsed is None else parsed
    values = path_values(parsed)
    order = cut(file_order(lines), "drift-files")
    steps = order.filter("prev_file is not null").select("run", "file_name", "prev_file")
    stats = cut(path_stats(values), "drift-stats")
    old = stats.join(
        steps.select("run", F.col("file_name").alias("step"), F.col("prev_file").alias("file_name")), FILE
    ).select("run", "step", "field_name", F.col("kinds").alias("old_kinds"))
    new = stats.join(steps.select("run", "file_name"), FILE).select(
        "run", F.col("file_name").alias("step"), "field_name", F.col("kinds").alias("new_kinds")
    )
    both = old.join(new, ["run", "step", "field_name"], "full_outer")
    moved = cut(
        both.filter("old_kinds is null or new_kinds is null or old_kinds != new_kinds").withColumn(
            "raw_change",
            F.when(F.col("old_kinds").isNull(), "added").when(F.col("new_kinds").isNull(), "removed").otherwise("retyped"),
        ),
        "drift-moved",
    )
    retyped = moved.filter("raw_change = 'retyped'").select("run", "step", "field_name", F.lit("retyped").alias("change_kind"))

    # Texts of gone fields in the earlier file and of new fields in the later one, for shared jobs only.
    jobs = parsed.filter("job is not null").select(*FILE, "job").distinct()
    shared = (
        steps.join(jobs, FILE)
        .join(jobs.select("run", F.col("file_name").alias("prev_file"), "job"), ["run", "prev_file", "job"], "left_semi")
        .select("run", F.col("file_name").alias("step"), "job")
    )
    gone = moved.filter("raw_change = 'removed'").select("run", "step", "field_name")
    came = moved.filter("raw_change = 'added'").select("run", "step", "field_name")
    # Which fields of which files are compared: a small written table, so Spark knows its size.
    wanted = cut(
        gone.join(steps.withColumnRenamed("file_name", "step"), ["run", "step"]).select(
            "run", "step", F.col("prev_file").alias("file_name"), "field_name", F.lit("removed").alias("side")
        ).unionByName(came.select("run", "step", F.col("step").alias("file_name"), "field_name", F.lit("added").alias("side"))),
        "drift-wanted",
    )
    held = values.filter("job is not null").select(*FILE, "line_no", "job", "field_name", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))
    compared = held.join(wanted, [*FILE, "field_name"])
    firsts = (
        compared.groupBy("run", "step", "side", "field_name", "job")
        .agg(F.min(F.struct("line_no", "h1", "h2")).alias("t"))
        .join(shared, ["run", "step", "job"], "left_semi")
    )
    marks = firsts.groupBy("run", "step", "side", "field_name").agg(
        F.count("*").alias("n_jobs"),
        F.sum(F.xxhash64("job", "t.h1").cast("decimal(20,0)")).alias("mark_a"),
        F.sum(F.xxhash64("t.h2", "job").cast("decimal(20,0)")).alias("mark_b"),
    )
    keys = ["run", "step", "n_jobs", "mark_a", "mark_b"]
    links = cut(
        marks.filter("side = 'removed'").select(*keys, F.col("field_name").alias("old_name"))
        .join(marks.filter("side = 'added'").select(*keys, "field_name"), keys)
        .select("run", "step", "old_name", "field_name", "n_jobs"),
        "drift-links",
    )
    renamed = links.select("run", "step", "field_name", F.lit("renamed").alias("change_kind"), "old_name", "n_jobs")
    removed = (
        gone.join(links.select("run", "step", F.col("old_name").alias("field_name")), ["run", "step", "field_name"], "left_anti")
        .withColumn("change_kind", F.lit("removed"))
    )
    added = came.join(links, ["run", "step", "field_name"], "left_anti").withColumn("change_kind", F.lit("added"))
    return (
        renamed.unionByName(removed, allowMissingColumns=True)
        .unionByName(added, allowMissingColumns=True)
        .unionByName(retyped, allowMissingColumns=True)
        .withColumnRenamed("step", "file_name")
    )


def canonical_names(stats: DataFrame, changes: DataFrame) -> dict[str, str]:
    """Field name -> the name it goes by in the consistent table.

    Works on names only (the width of the schema, never rows). Spellings that differ in case and
    underscores join; a rename joins two names by falling support, unless they occur in one file,
    as all-zero fields can look alike. The name with most values stands for its set.
    """
    support = {r[0]: r[1] for r in stats.groupBy("field_name").agg(F.sum("n_values")).collect()}
    together: dict[str, set[str]] = {name: set() for name in support}
    pairs = stats.groupBy(*FILE).agg(F.array_sort(F.collect_set("field_name")).alias("names")).select("names").distinct()
    for (names,) in pairs.collect():
        for name in names:
            together[name].update(names)
    sets: dict[str, set[str]] = {name: {name} for name in support}

    def join(a: str, b: str) -> None:
        if sets[a] is sets[b] or any(together[x] & sets[b] for x in sets[a]):
            return
        merged = sets[a] | sets[b]
        for x in merged:
            sets[x] = merged

    spelled: dict[str, str] = {}
    for name in sorted(support, key=lambda x: (-support[x], x)):
        plain = re.sub(r"[^a-z0-9]", "", name.lower())
        if plain in spelled:
            join(spelled[plain], name)
        spelled.setdefault(plain, name)
    edges = changes.filter("change_kind = 'renamed'").groupBy("old_name", "field_name").agg(F.sum("n_jobs").alias("n"))
    for old, new, _ in sorted(edges.collect(), key=lambda r: (-r[2], r[0], r[1])):
        if old in sets and new in sets:
            join(old, new)
    return {name: max(group, key=lambda x: (support[x], x)) for name, group in sets.items()}


def _target_types(values: DataFrame, names: dict[str, str]) -> dict[str, str]:
    """The raw type most values of a canonical field have; ties go to string, then number."""
    best: dict[str, dict[str, int]] = {}
    for name, kind, n in values.groupBy("field_name", "kind").agg(F.count("*")).collect():
        counts = best.setdefault(names[name], {})
        counts[kind] = counts.get(kind, 0) + n
    rank = {"string": 3, "number": 2, "boolean": 1, "object": 0, "array": 0}
    return {name: max(c, key=lambda k: (c[k], rank[k])) for name, c in best.items()}


def _typed(text, target: str):
    if target == "number":
        return F.when(F.lower(text).isin("true", "false"), F.lower(text).eqNullSafe("true").cast("double")).otherwise(
            text.try_cast("double")
        )
    if target == "boolean":
        return F.when(text.isin("1", "0"), text == "1").otherwise(text.try_cast("boolean"))
    return text


def consistent_table(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, failures): one row per JSON line with canonical, typed columns; the values that a cast lost.

    Strings keep their text, numbers are double (true and false count as 1 and 0), booleans take
    1 and 0; objects and arrays stay JSON text. A line with two spellings of one field keeps the
    canonical spelling, else the first by name. An empty table gives the key columns only.
    """
    parsed = parsed_lines(lines)
    values = path_values(parsed)
    names = canonical_names(path_stats(values), schema_changes(lines, parsed))
    targets = _target_types(values, names)
    spark = lines.sparkSession
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("field_name", "canonical", "target")])
    dim = spark.createDataFrame([(k, v, targets[v]) for k, v in sorted(names.items())], schema)
    named = values.join(F.broadcast(dim), "field_name")  # as many rows as the schema has names
    one = named.groupBy("line_id", "run", "file_name", "line_no", "job", "canonical").agg(
        F.min_by(
            F.struct("text", "field_name", "target"),
            F.struct((F.col("field_name") != F.col("canonical")).cast("int"), "field_name"),
        ).alias("c")
    )
    columns = sorted(targets)
    wide = one.groupBy("line_id", "run", "file_name", "line_no").pivot("canonical", columns or ["job_id"]).agg(F.first("c.text"))
    table = wide.select(
        "line_id", "run", "file_name", "line_no", *[_typed(F.col(f"`{c}`"), targets[c]).alias(c) for c in columns]
    )
    lost = F.when(F.col("target") == "number", _typed(F.col("text"), "number").isNull()).when(
        F.col("target") == "boolean", _typed(F.col("text"), "boolean").isNull()
    ).otherwise(F.lit(False))
    failures = named.filter(lost).groupBy("run", "file_name", "field_name", "canonical", "target", "kind").agg(
        F.count("*").alias("n_failed"), F.min("text").alias("example")
    )
    return table, failures
