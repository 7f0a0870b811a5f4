"""Mapping freely typed values to a canonical list by a prefix-filter set-similarity join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stemwright.session import cut

# Other ways to write an entry of a rating list.
ALIASES = {
    "yes": ["y", "yes", "yeah", "yep", "yea", "yup"],
    "no": ["n", "no", "nope", "nah", "n0"],
    "unsure": ["unsure", "not sure", "unsr", "uncertain"],
    "not applicable": ["not applicable", "na", "n a", "not appl", "not applic", "inapplicable"],
    "minor edits": ["minor edits", "minor", "min edits", "min ed", "minor ed"],
    "major edits": ["major edits", "major", "maj edits", "maj ed", "major ed"],
    "cannot judge": ["cannot judge", "cannot say", "cant judge", "can not judge", "cannot tell", "cant say"],
}
# Labels and marks that stand before a rating, and what separates a remark after it.
_LABEL = (
    r"^(?:[\s*>#~=:.,;-]+|(?:q\s*\d+|my rating|rating|my answer|answer|ans|score|verdict|overall|i say|needs?)\b\s*[:=.)-]*\s+"
    r"|(?:q\s*\d+|my rating|rating|answer|ans)\s*[:=]\s*|\((?!blank)[^()]*\)\s*(?=\S)|\d+[.)]\s+)"
)
_REMARK = r"\s*(?:\|\||[|;\[({:]|\s[-–—]+\s|--|\s(?:because|since|but|as the|see)\b).*$"
_EITHER = r"^either\s+"


def rating_core(cell: Column) -> Column:
    """The rating at the start of a cell: lower case, without labels, marks and remarks."""
    text = F.trim(F.regexp_replace(F.lower(cell), r"(?U)\s+", " "))
    for _ in range(3):
        text = F.regexp_replace(text, _LABEL, "")
    return F.trim(F.regexp_replace(text, _REMARK, ""))


def alternatives(core: Column) -> Column:
    """The ratings a core offers, each with letters, digits and single blanks only."""
    one = F.regexp_replace(core, r"\bn\s*/\s*a\b", "na")
    parts = F.split(F.regexp_replace(one, _EITHER, ""), r"\s+or\s+|\s*/\s*|\s+and\s+")
    plain = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"['’.]", ""), r"[^a-z0-9]+", " ")))
    # A word or phrase said twice is said once.
    once = F.transform(plain, lambda p: F.regexp_replace(p, r"^(.+?)(?: \1)+$", "$1"))
    return F.filter(once, lambda p: p != "")


def tokens(text: Column) -> Column:
    """Set of a value: its letters and its pairs of neighbours with the ends, the k-th copy of each apart."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))
    flat = F.array_sort(F.concat(chars, pairs))
    return F.array_distinct(
        F.transform(flat, lambda x, i: F.concat(x, F.lit("#"), (i - F.array_position(flat, x)).cast("string")))
    )


def best_matches(values: DataFrame, references: DataFrame, similarity: float = 0.4) -> DataFrame:
    """(grp, value, entry_id, jaccard) of the closest reference of the same group; values without one are left out.

    values: distinct (grp, value); references: (grp, name, entry_id). Tokens are ordered by rarity over both
    sides; a pair meets only if the rare prefixes of both share a token, and passes the length and the
    positional filter before its Jaccard similarity is computed exactly. If the best similarity is
    reached by two entries there is no match. Values too long for any reference are dropped by the
    length bound before they are tokenised, so very long texts cost nothing.
    """
    longest = references.agg(F.max(F.length("name"))).first()[0] or 0
    # A value of n letters has n + 1 pairs (and copies are kept apart), so its set has 2n + 1 tokens.
    fits = values.filter(F.length("value") <= (2 * longest + 1) / similarity)
    left = fits.select(F.lit("v").alias("side"), "grp", F.col("value").alias("name"), F.lit(None).cast("int").alias("entry_id"))
    right = references.select(F.lit("r").alias("side"), "grp", "name", "entry_id").distinct()
    both = cut(left.unionByName(right).withColumn("tokens", tokens(F.col("name"))), "map-records")
    exploded = both.select("side", "grp", "name", "entry_id", F.explode("tokens").alias("token"))
    rarity = exploded.groupBy("token").agg(F.count("*").alias("df"))
    ranked = (
        exploded.join(rarity, "token")
        .groupBy("side", "grp", "name", "entry_id")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
        .select("side", "grp", "name", "entry_id", F.col("t.token").alias("t"), F.size("t").alias("n"))
    )
    prefix = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1
    heads = cut(
        ranked.select("side", "grp", "name", "entry_id", "n", "t", F.posexplode(F.slice("t", F.lit(1), prefix.cast("int"))).alias("pos", "token")),
        "map-prefixes",
    )
    v = heads.filter("side = 'v'").select("grp", "token", F.col("name").alias("value"), F.col("n").alias("nv"), F.col("pos").alias("pv"), F.col("t").alias("tv"))
    r = heads.filter("side = 'r'").select("grp", "token", F.col("name").alias("ref"), "entry_id", F.col("n").alias("nr"), F.col("pos").alias("pr"), F.col("t").alias("tr"))
    overlap = F.lit(similarity) / (1 + similarity) * (F.col("nv") + F.col("nr")) - 1e-9
    met = (
        v.join(r, ["grp", "token"])
        .filter((F.col("nr") >= similarity * F.col("nv") - 1e-9) & (F.col("nv") >= similarity * F.col("nr") - 1e-9))
        .withColumn("ahead", 1 + F.least(F.col("nv") - F.col("pv") - 1, F.col("nr") - F.col("pr") - 1))
        .groupBy("grp", "value", "ref", "entry_id")
        .agg(F.first("nv").alias("nv"), F.first("nr").alias("nr"), F.first("tv").alias("tv"), F.first("tr").alias("tr"), F.max("ahead").alias("most"))
        .filter(F.col("most") >= overlap)  # the first shared token has the longest rest, all that can still match
    )
    common = F.size(F.array_intersect("tv", "tr"))
    scored = (
        met.select("grp", "value", "entry_id", (common / (F.col("nv") + F.col("nr") - common)).alias("jaccard"))
        .filter(F.col("jaccard") >= similarity - 1e-9)
        .groupBy("grp", "value", "entry_id").agg(F.max("jaccard").alias("jaccard"))
    )
    w = W.partitionBy("grp", "value")
    return (
        scored.withColumn("top", F.max("jaccard").over(w)).filter("jaccard >= top - 1e-9")
        .withColumn("ties", F.count("*").over(w)).filter("ties = 1").select("grp", "value", "entry_id", "jaccard")
    )


def map_cells(cells: DataFrame, entries: DataFrame, similarity: float = 0.4) -> DataFrame:
    """cells (grp, raw, ...) with entry_id and jaccard: the entry meant, 0 where none or two are meant.

    entries: (grp, entry, entry_id), a bounded list; every entry is matched by its own text and its
    aliases. Each distinct core is mapped once, so repeated cells cost one match; a part offered next to
    an entry but unlike any entry doesn't count. NULL and blank cells get 0. Other columns are kept, but for
    core, entry_id and jaccard, which are set anew.
    """
    spark = cells.sparkSession
    cells = cells.drop("core", "entry_id", "jaccard")
    cored = cells.withColumn("core", rating_core(F.col("raw")))
    cores = cut(cored.select("grp", "core").distinct().withColumn("parts", alternatives(F.col("core"))), "map-cores")
    rows = [(entry, alias) for entry, aliases in ALIASES.items() for alias in aliases]
    aliases = F.broadcast(spark.createDataFrame(rows, "entry string, name string"))  # the fixed list above
    named = entries.withColumn("entry", F.lower(F.trim("entry")))
    references = (
        named.select("grp", F.col("entry").alias("name"), "entry_id")
        .union(named.join(aliases, "entry").select("grp", "name", "entry_id"))
        .distinct()
    )
    offered = cores.select("grp", "core", F.explode("parts").alias("value"))
    matched = best_matches(offered.select("grp", "value").distinct(), references, similarity)
    meant = (
        offered.join(matched, ["grp", "value"]).groupBy("grp", "core")
        .agg(F.count_distinct("entry_id").alias("k"), F.min("entry_id").alias("entry_id"), F.max("jaccard").alias("jaccard"))
    )
    one = meant.select("grp", "core", F.when(F.col("k") == 1, F.col("entry_id")).alias("entry_id"), "jaccard")
    return cored.join(one, ["grp", "core"], "left").withColumn("entry_id", F.coalesce("entry_id", F.lit(0)))
