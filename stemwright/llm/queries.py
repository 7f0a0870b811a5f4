"""The training-data queries (pN_...) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemwright.llm import consensus, entity_map, fusion, leaks, mixing, mojibake, near_duplicates, sampling, truncation
from stemwright.session import cut, table


def job_key(name: str = "job_id"):
    return F.lower(F.trim(F.col(name)))


# ---- problem 5: stems repeated with small changes
def _stem_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(classes of stems with their jobs, pairs of similar classes)."""
    stems = (
        table(spark, sf_dir, "items_full").filter("stem is not null and job_id is not null")
        .select(F.col("ord").alias("row_id"), job_key().alias("job"), F.col("stem").alias("text"))
    )
    classes, counts = near_duplicates.text_classes(stems, ["job"], 3)
    return classes, near_duplicates.similar_texts(classes, counts, stems)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of jobs; only those of jobs with several different stems can come twice, so only they are shuffled as pairs."""
    classes, links = _stem_links(spark, sf_dir)
    members = classes.select("job", "h").distinct()
    members = cut(members.withColumn("n", F.count("*").over(Window.partitionBy("job"))), "stem-members")
    one, several = members.filter("n = 1"), members.filter("n > 1")
    a = lambda df: df.select(F.col("job").alias("x"), F.col("h").alias("h_a"))
    b = lambda df: df.select(F.col("job").alias("y"), F.col("h").alias("h_b"))
    links = links.select("h_a", "h_b")
    once = links.join(a(one), "h_a").join(b(one), "h_b").select("x", "y").unionAll(
        a(one).join(b(one), (F.col("h_a") == F.col("h_b")) & (F.col("x") < F.col("y"))).select("x", "y")
    )
    ways = links.unionAll(links.select(F.col("h_b").alias("h_a"), F.col("h_a").alias("h_b")))
    again = ways.join(a(several), "h_a").join(b(members), "h_b").select("x", "y").unionAll(
        a(several).join(b(members), F.col("h_a") == F.col("h_b")).select("x", "y")
    )
    ordered = lambda df: df.filter("x != y").select(F.least("x", "y").alias("job_a"), F.greatest("x", "y").alias("job_b"))
    return ordered(once).unionAll(ordered(again).distinct())


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct stem text of a job: its class (the text), its group of linked classes, and its links."""
    classes, links = _stem_links(spark, sf_dir)
    members = classes.groupBy("h", "job").agg(F.count("*").alias("n_rows"))
    linked = links.select(F.explode(F.array("h_a", "h_b")).alias("h")).groupBy("h").agg(F.count("*").alias("n_links"))
    groups = near_duplicates.connected_components(linked, links)
    return (
        members.join(linked.join(groups, "h"), "h", "left")
        .select(
            "job", F.col("h").alias("class_id"), "n_rows", F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("component", "h").alias("group_id"),
        )
    )


# ---- problem 3: one surviving record for each job
_FIELDS = ["stem", "answer", "rationale", "provider", "cost_usd"]


def _no_error():
    said = F.lower(F.trim("parse_error"))
    return said.isNull() | said.isin("", "none")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = -F.unix_micros(F.col("requested_at").cast("timestamp"))
    order = [
        (~F.coalesce("analysed", F.lit(False))).cast("int"),
        (~_no_error()).cast("int"),
        F.coalesce(late, F.lit(2**62)),
    ]
    rows = table(spark, sf_dir, "items_full").select("ord", "analysed", "parse_error", "requested_at", job_key().alias("job_id"), *_FIELDS)
    return fusion.preferred_rows(rows, "job_id", "ord", _FIELDS, order)


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each attempt of a job with several rows says of its fields; a source is a provider and the state of the row."""
    state = F.concat_ws(
        "/", F.coalesce("provider", F.lit("?")), F.when(F.coalesce("analysed", F.lit(False)), "analysed").otherwise("not analysed"),
        F.when(_no_error(), "clean").otherwise("error"),
    )
    rows = table(spark, sf_dir, "items_full").filter("job_id is not null").withColumn("entity", job_key()).withColumn("source", state)
    several = rows.groupBy("entity").agg(F.count("*").alias("n")).filter("n >= 2").select("entity")
    values = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in _FIELDS])
    )
    return (
        rows.join(several, "entity", "left_semi").select("entity", "source", values.alias("v"))
        .select("entity", "source", "v.field_name", "v.value").filter(r"value rlike '(?U)\\S'")
    )


def p3_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.truth_discovery(_claims(spark, sf_dir))[0].withColumnRenamed("entity", "job_id")


def p3_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.truth_discovery(_claims(spark, sf_dir))[1]


# ---- problem 4: a sample of jobs that stays as the log grows
SAMPLE_SHARE = 0.125


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the sampled jobs; a job's stratum is that of its first row."""
    rows = table(spark, sf_dir, "items_full").filter("job_id is not null").select(
        "ord", job_key().alias("job_id"), "model_label", "condition"
    )
    first = rows.groupBy("job_id").agg(F.min(F.struct("ord", "model_label", "condition")).alias("f"))
    jobs = first.select("job_id", F.col("f.ord").alias("first_ord"), "f.model_label", "f.condition")
    kept = sampling.golden_sample(jobs, ["model_label", "condition"], "first_ord", SAMPLE_SHARE)
    return rows.select("ord", "job_id").join(kept.select("job_id", "model_label", "condition", "seq"), "job_id")


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_sample(spark, sf_dir).groupBy("model_label", "condition").agg(
        F.count_distinct("job_id").alias("n_jobs"), F.count("*").alias("n_rows")
    )


# ---- problem 6: texts cut off
def _long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("stem", "rationale")]))
    return (
        table(spark, sf_dir, "items_full").select(F.col("ord").alias("row_id"), "provider", both.alias("b"))
        .select("row_id", "provider", "b.field_name", "b.text")
        .withColumn("n_chars", F.length("text"))
    )


def _truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(_long_texts(spark, sf_dir), ["provider", "field_name"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(spark, sf_dir).select(F.col("row_id").alias("ord"), "field_name")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut texts for each provider and field."""
    texts = _long_texts(spark, sf_dir).filter(r"text rlike '(?U)\\S'")
    cases = _truncated(spark, sf_dir).select("row_id", "field_name", F.lit(1).alias("is_cut"))
    return texts.select("row_id", "provider", "field_name").join(cases, ["row_id", "field_name"], "left").groupBy("provider", "field_name").agg(
        F.count("*").alias("n_texts"), F.count("is_cut").alias("n_cut"), (F.count("is_cut") / F.count("*")).alias("share_cut")
    )


def p6_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.length_hazards(_long_texts(spark, sf_dir), ["provider", "field_name"]).filter("significant")


# ---- problem 1: typed ratings to the entries of the rating lists
def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that are not blank and not exactly an entry of their question, with the entry meant."""
    main = table(spark, sf_dir, "main_r2").select(F.lit("main_r2").alias("src"), "row_id", F.array(F.struct(F.lit("q5").alias("grp"), F.col("q5_raw").alias("raw"))).alias("c"))
    cal = table(spark, sf_dir, "calibration_r2").select(
        F.lit("calibration_r2").alias("src"), "row_id",
        F.array(*[F.struct(F.lit(q).alias("grp"), F.col(f"{q}_raw").alias("raw")) for q in ("q1", "q2")]).alias("c"),
    )
    entries = table(spark, sf_dir, "rating_entries").select(F.col("question").alias("grp"), "entry", "entry_id")
    cells = main.unionByName(cal).select("src", "row_id", F.explode("c").alias("c")).select("src", "row_id", "c.grp", "c.raw").filter(r"raw rlike '(?U)\\S'")
    exact = F.broadcast(entries.select("grp", F.col("entry").alias("raw")))  # rating_entries is a fixed table of 21 rows
    return entity_map.map_cells(cells.join(exact, ["grp", "raw"], "left_anti"), entries)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("src", "row_id", F.concat("grp", F.lit("_raw")).alias("field_name"), "entry_id")


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that mean no entry of their list, or two, with how often each was typed."""
    return _mapped(spark, sf_dir).filter("entry_id = 0").groupBy("grp", "raw").agg(F.count("*").alias("n_cells"))


# ---- problem 7: consensus of several raters
_STRIP = r"(?U)^\s+|\s+$"
_READER = {"q1_longest": "q1_longest", "q2_repetition": "q2_repetition", "q3_absolute": "q3_absolute"}


def clean(name: str):
    return F.regexp_replace(F.lower(F.col(name)), _STRIP, "")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, question, rater, label): each rater once for an item, by the latest row; blank is no vote."""
    questions = [f"q{i}" for i in range(1, 6)]
    columns = ["item_id", "rater", "submitted_utc", "row_id", *questions]
    ratings = table(spark, sf_dir, "main_r1").select(*columns).unionByName(table(spark, sf_dir, "main_r2").select(*columns))
    latest = (
        ratings.filter("item_id is not null")
        .withColumn("rater", F.coalesce(clean("rater"), F.lit("")))
        .groupBy("item_id", "rater")
        .agg(F.max(F.struct(F.col("submitted_utc"), F.col("row_id"), *questions)).alias("r"))
        .select("item_id", "rater", "r.*")
    )
    rated = latest.select("item_id", "rater", F.explode(F.array(*[F.struct(F.lit(q).alias("question"), F.col(q).alias("label")) for q in questions])).alias("v"))
    readers = table(spark, sf_dir, "reader_check").filter("item_id is not null")
    cells = [
        F.struct(F.lit(f"reader{i}").alias("rater"), F.struct(F.lit(q).alias("question"), F.col(f"reader{i}_{c}").alias("label")).alias("v"))
        for i in (1, 2) for q, c in _READER.items()
    ]
    read = readers.select("item_id", F.explode(F.array(*cells)).alias("c")).select("item_id", "c.rater", "c.v")
    return rated.unionByName(read).select(
        "item_id", "v.question", "rater", F.regexp_replace(F.lower("v.label"), _STRIP, "").alias("label")
    ).filter("label != ''")


def _consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus_labels(cut(votes(spark, sf_dir), "votes"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most probable label of each item and question by the annotator model, where at least two votes and more than half of them support it.

    An item whose majority the model overrules (p7_overruled) keeps the majority's label, as the result is defined by votes.
    """
    chosen = F.when(F.expr("n >= 2 and 2 * n > n_votes"), F.col("label")).when(F.expr("top >= 2 and 2 * top > n_votes"), F.col("top_label"))
    return _consensus(spark, sf_dir).select("item_id", "question", chosen.alias("label")).filter("label is not null")


def p7_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most probable label of each item and question, whether or not a majority holds it."""
    return _consensus(spark, sf_dir).select("item_id", "question", "label", "n", "n_votes", "posterior")


def p7_overruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items where the model prefers another label than the one a majority of two votes or more holds."""
    rows = _consensus(spark, sf_dir).filter("top >= 2 and 2 * top > n_votes and label != top_label")
    return rows.select("item_id", "question", "label", "top_label", "posterior")


def p7_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.agreement(votes(spark, sf_dir)).select(
        "question", "n_votes", F.round("raw_agreement", 6).alias("raw_agreement"), F.round("alpha", 6).alias("alpha")
    )


def p7_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.annotator_model(cut(votes(spark, sf_dir), "votes"))[1]


# ---- problem 8: held-out items in documents
def _passages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "reference_items").select(F.col("itemnum").cast("long").alias("id"), F.col("itemstem_text").alias("text"))
    return docs, items


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(*_passages(spark, sf_dir)).select("doc_id", F.col("item_id").cast("int").alias("itemnum"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each leaked item the documents that hold some of it and the most passages one of them holds."""
    return (
        leaks.leaked_items(*_passages(spark, sf_dir)).groupBy(F.col("item_id").cast("int").alias("itemnum"))
        .agg(F.count("*").alias("n_docs"), F.max("n_passages").alias("most_passages"))
    )


# ---- problem 9: a mixture of sources
def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", mixing.source_key(F.col("source")).alias("source"), "text")
    targets = table(spark, sf_dir, "mix_targets")
    named = docs.join(F.broadcast(targets.select("source")), "source")  # mix_targets is a fixed table of 9 rows
    return mixing.mixture(mixing.token_counts(named, mixing.tokenizer_path()), targets)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


# ---- problem 10: garbled documents
def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", mixing.source_key(F.col("source")).alias("source"), "text").filter("text is not null")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_documents(_texts(spark, sf_dir))[0].select("doc_id")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return mojibake.restored_documents(texts, *mojibake.garbled_documents(texts))


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source has which wrong reading."""
    return mojibake.garbled_documents(_texts(spark, sf_dir))[0].groupBy("source", "swap").agg(F.count("*").alias("n_docs"))


QUERIES = {
    "p10_found": p10_found, "p10_restored": p10_restored, "p10_sources": p10_sources,
    "p1_found": p1_found, "p1_unmatched": p1_unmatched,
    "p7_found": p7_found, "p7_consensus": p7_consensus, "p7_overruled": p7_overruled, "p7_agreement": p7_agreement, "p7_raters": p7_raters,
    "p8_found": p8_found, "p8_items": p8_items, "p9_mixture": p9_mixture, "p9_shares": p9_shares,
    "p3_found": p3_found, "p3_truth": p3_truth, "p3_sources": p3_sources, "p4_sample": p4_sample, "p4_shares": p4_shares,
    "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_rates": p6_rates, "p6_hazards": p6_hazards,
}

_STEM_JOBS = """
WITH m AS (SELECT DISTINCT lower(trim(job_id, ' ')) AS job,
  trim(regexp_replace(lower(stem), '[^a-z0-9]+', ' ', 'g')) AS norm FROM items_full WHERE stem IS NOT NULL AND job_id IS NOT NULL)
"""

_SAMPLE = """
WITH r AS (SELECT ord, lower(trim(job_id, ' ')) AS job_id, model_label, condition FROM items_full WHERE job_id IS NOT NULL),
f AS (SELECT job_id, min(ord) AS first_ord, arg_min(coalesce(model_label, ''), ord) AS ml, arg_min(coalesce(condition, ''), ord) AS co FROM r GROUP BY job_id),
s AS (SELECT *, (row_number() OVER (PARTITION BY ml, co ORDER BY first_ord) - 1)::BIGINT AS seq FROM f),
k AS (SELECT * FROM s WHERE (seq::HUGEINT * 2654435769 + ('0x' || substr(md5('7|' || ml || '|' || co), 1, 8))::BIGINT) % 4294967296 < 536870912)
"""

_VOTES = r"""
WITH a AS (SELECT item_id, coalesce(lower(trim(rater)), '') AS rater, submitted_utc, row_id, q1, q2, q3, q4, q5 FROM main_r1 WHERE item_id IS NOT NULL
  UNION ALL SELECT item_id, coalesce(lower(trim(rater)), ''), submitted_utc, row_id, q1, q2, q3, q4, q5 FROM main_r2 WHERE item_id IS NOT NULL),
l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY item_id, rater ORDER BY submitted_utc DESC NULLS LAST, row_id DESC) = 1),
u AS (SELECT item_id, rater, unnest(['q1', 'q2', 'q3', 'q4', 'q5']) AS question, unnest([q1, q2, q3, q4, q5]) AS label FROM l
  UNION ALL SELECT item_id, 'reader1', unnest(['q1_longest', 'q2_repetition', 'q3_absolute']), unnest([reader1_q1_longest, reader1_q2_repetition, reader1_q3_absolute]) FROM reader_check
  UNION ALL SELECT item_id, 'reader2', unnest(['q1_longest', 'q2_repetition', 'q3_absolute']), unnest([reader2_q1_longest, reader2_q2_repetition, reader2_q3_absolute]) FROM reader_check),
v AS (SELECT item_id, question, rater, lower(trim(label)) AS label FROM u WHERE trim(label) <> ''),
c0 AS (SELECT item_id, question, label, count(*) AS n FROM v GROUP BY item_id, question, label),
c AS (SELECT *, sum(n) OVER (PARTITION BY item_id, question) AS m FROM c0)
"""

ORACLE: dict[str, str] = {
    "p7_found": _VOTES + "SELECT item_id, question, label FROM c WHERE n >= 2 AND 2 * n > m",
    "p7_agreement": _VOTES
    + """, d AS (SELECT * FROM c WHERE m >= 2),
t AS (SELECT question, sum(k * k) AS sq FROM (SELECT question, label, sum(n) AS k FROM d GROUP BY question, label) GROUP BY question),
s AS (SELECT question, sum(n)::DOUBLE AS nn, sum(n * (m - n) / (m - 1))::DOUBLE AS df FROM d GROUP BY question)
SELECT question, nn::BIGINT AS n_votes, round(1 - df / nn, 6) AS raw_agreement,
  round(1 - (df / nn) / ((nn * nn - sq) / (nn * (nn - 1))), 6) AS alpha FROM s JOIN t USING (question)""",
    "p8_found": r"""
WITH i AS (SELECT itemnum, string_split(trim(regexp_replace(lower(itemstem_text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM reference_items),
p AS (SELECT itemnum, ' ' || array_to_string(w[g:g + 12], ' ') || ' ' AS p FROM i, unnest(generate_series(1, len(w) - 12)) AS s(g)),
d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
q AS (SELECT doc_id, ' ' || array_to_string(w[g:g + 12], ' ') || ' ' AS p FROM d, unnest(generate_series(1, len(w) - 12)) AS s(g))
SELECT DISTINCT doc_id, itemnum FROM q JOIN p USING (p)""",
    "p3_found": "\nUNION ALL\n".join(
        f"""(SELECT lower(trim(job_id, ' ')) AS job_id, '{f}' AS field_name,
  first(ord ORDER BY coalesce(analysed, false) DESC, (parse_error IS NOT NULL AND lower(trim(parse_error)) NOT IN ('', 'none')),
  requested_at DESC NULLS LAST, ord) FILTER (WHERE {f} IS NOT NULL AND trim({f}::VARCHAR, E' \\t\\n\\r') <> '') AS ord FROM items_full WHERE job_id IS NOT NULL
  GROUP BY ALL HAVING count(*) >= 2 AND count(*) FILTER (WHERE {f} IS NOT NULL AND trim({f}::VARCHAR, E' \\t\\n\\r') <> '') > 0)"""
        for f in _FIELDS
    ),
    "p4_sample": _SAMPLE + "SELECT r.ord, k.job_id, nullif(ml, '') AS model_label, nullif(co, '') AS condition, seq FROM k JOIN r USING (job_id)",
    "p4_shares": _SAMPLE
    + """SELECT nullif(ml, '') AS model_label, nullif(co, '') AS condition, count(DISTINCT job_id)::BIGINT AS n_jobs, count(*)::BIGINT AS n_rows
    FROM k JOIN r USING (job_id) GROUP BY ALL""",
}
