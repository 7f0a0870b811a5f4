"""Items and flags from the log of generation attempts, and the SQL that says the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stemwright.functions import text as tx
from stemwright.operators import detector
from stemwright.operators.detector import RULES
from stemwright.session import cut, table

OPTION_COLUMNS = {letter: f"option_{letter.lower()}" for letter in "ABCDE"}
META = [
    "job_id", "model_label", "tier", "specialty", "topic_index", "condition", "rep", "reasoning_mode", "target_position",
    "temperature", "provider", "reasoning_tokens",
]


def usable_rows(attempts: DataFrame) -> DataFrame:
    """Attempts that hold a whole item: stem, five options and a key among them."""
    whole = F.col("job_id").isNotNull() & (F.length(F.trim(F.coalesce("stem", F.lit("")))) > 0)
    for c in OPTION_COLUMNS.values():
        whole &= F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    return attempts.filter(whole & F.upper(F.trim("answer")).isin(*"ABCDE")).withColumn("job_id", F.lower(F.trim("job_id")))


def first_usable(attempts: DataFrame) -> DataFrame:
    """The first usable attempt of each job, in the order of the log."""
    w = W.partitionBy("job_id").orderBy("ord")
    return usable_rows(attempts).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each job, defaults filled in, options as an array."""
    first = first_usable(table(spark, sf_dir, "items_full"))
    return first.select(
        *[c for c in META if c not in ("tier", "reasoning_mode", "temperature", "provider", "reasoning_tokens")],
        F.coalesce("tier", F.lit("base")).alias("tier"), F.coalesce("reasoning_mode", F.lit("off")).alias("reasoning_mode"),
        F.coalesce("temperature", F.lit(0.7)).alias("temperature"), F.coalesce("provider", F.lit("")).alias("provider"),
        F.coalesce("reasoning_tokens", F.lit(0)).alias("reasoning_tokens"), "stem", "rationale", "answer",
        detector.options_of(OPTION_COLUMNS).alias("options"),
    )


_written: dict[tuple, DataFrame] = {}


def _state(spark: SparkSession, files: list[str]) -> tuple:
    """Names, sizes and times of the files a table is read from."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for name in sorted(files):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags table of the log, detected once for a state of its files and written to the shared folder, as every report reads it."""
    key = (spark.sparkContext.applicationId, _state(spark, table(spark, sf_dir, "items_full").inputFiles()))
    held = _written.get(key)
    if held is None or not _there(held):
        held = _written[key] = cut(detector.detect(items(spark, sf_dir), keep=META), "flags")
    return held


def _there(df: DataFrame) -> bool:
    paths = [f.removeprefix("file:") for f in df.inputFiles() if f.startswith("file:")]
    return all(os.path.exists(p.replace("///", "/", 1)) for p in paths)


def main_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of the main corpus: plain and guided prompts without reasoning, with the composite and 0/1 covariates."""
    main = flags(spark, sf_dir).filter("condition in ('plain', 'guided') and reasoning_mode = 'off'")
    return main.withColumns(
        {
            "any_flaw": detector.any_flaw(RULES), "guided": (F.col("condition") == "guided").cast("int"),
            "flagship": (F.col("tier") == "flagship").cast("int"), "key_a": (F.col("key") == "A").cast("int"),
            "topic": F.concat_ws(":", "specialty", "topic_index"),
        }
    )


# ---- the same in SQL
_SPACE = r"[\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(translate(coalesce({x}, ''), {_quote(tx.DASHES)}, '------'), {_quote(_SPACE)}, ' ', 'g'))"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_quote, values)) + "]"


def _tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[a-z][a-z\-'']+')"


def _content(x: str) -> str:
    stops = _list(sorted({w for w in tx.STOP_WORDS + tx.CLINICAL_STOP_WORDS if len(w) >= 4}))
    lemma = (
        "CASE WHEN w LIKE '%ies' AND len(w) >= 7 THEN w[:-4] || 'y' WHEN regexp_matches(w, '(xes|ches|shes|sses|zes)$') AND len(w) >= 6 THEN w[:-3] "
        "WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND len(w) >= 5 THEN w[:-2] WHEN w LIKE '%ing' AND len(w) >= 7 THEN w[:-4] "
        "WHEN w LIKE '%ed' AND len(w) >= 6 THEN w[:-3] ELSE w END"
    )
    return (
        f"list_distinct(list_transform(list_filter(list_transform({_tokens(x)}, lambda v: trim(v, '-''')), "
        f"lambda v: len(v) >= 4 AND NOT list_contains({stops}, v)), lambda w: {lemma}))"
    )


def _words(x: str) -> str:
    return f"len(list_filter(string_split({x}, ' '), lambda q: q <> ''))"


def _numeric(x: str) -> str:
    return rf"(regexp_matches({x}, '^{tx.NUMBER}') AND len(regexp_replace({x}, '[\d\s.,%/:+\-–]', '', 'g')) <= 12)"


def _sentence(x: str) -> str:
    return f"({x} LIKE '%.' AND {_words(x)} >= 4)"


def _exempt(x: str) -> str:
    out = f"lower({x})"
    for pattern in detector.ABSOLUTE_EXEMPT:
        out = f"regexp_replace({out}, {_quote(pattern)}, ' ', 'g')"
    return out


_USABLE = " AND ".join(
    ["job_id IS NOT NULL", "trim(coalesce(stem, ''), ' ') <> ''", "upper(trim(answer, ' ')) IN ('A', 'B', 'C', 'D', 'E')"]
    + [f"trim(coalesce({c}, ''), ' ') <> ''" for c in OPTION_COLUMNS.values()]
)
ITEMS_SQL = f"""usable AS (SELECT * REPLACE (lower(trim(job_id, ' ')) AS job_id) FROM items_full WHERE {_USABLE}),
first AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ord) = 1),
items AS (SELECT * REPLACE (coalesce(tier, 'base') AS tier, coalesce(reasoning_mode, 'off') AS reasoning_mode, coalesce(temperature, 0.7) AS temperature,
  coalesce(provider, '') AS provider, coalesce(reasoning_tokens, 0) AS reasoning_tokens) FROM first)"""

_META = ", ".join(META)
_ANY = lambda test: f"len(list_filter(o, lambda x: {test})) > 0"
FLAGS_SQL = f"""{ITEMS_SQL},
d1 AS (SELECT {_META}, rationale, {_norm('stem')} AS st, [{', '.join(_norm(c) for c in OPTION_COLUMNS.values())}] AS o,
  upper(regexp_extract(trim(answer), '(?i)^\\(?\\s*(?:option|answer|choice)?\\s*:?\\s*\\(?\\s*([A-J])\\s*[).:]?\\s*\\)?$', 1)) AS key FROM items),
d2 AS (SELECT *, ascii(key) - 64 AS k, string_split(regexp_replace(st, '([.?!:])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM d1),
d3 AS (SELECT *, o[k] AS kt, list_concat(o[1:k - 1], o[k + 1:]) AS oth,
  coalesce(list_filter(parts, lambda s: s LIKE '%?' OR s LIKE '%:')[-1], parts[-1]) AS lead FROM d2),
d4 AS (SELECT *, regexp_replace(lead, '(?i)\\bat least\\b|\\bnot only\\b', ' ', 'g') AS asked, {_content('st')} AS sw, {_content('kt')} AS kw,
  list_transform(oth, lambda d: {_content('d')}) AS ow, list_transform(o, lambda x: {_numeric('x')}) AS nu,
  list_transform(o, lambda x: trim(lower(x), ' .;:,')) AS low, list_sort(list_transform(o, lambda x: len(x))) AS ln,
  list_transform(o, lambda x: greatest({_words('x')}, 1)::DOUBLE) AS wc,
  lower(regexp_extract(trim(lead), '(?i)\\b(an|a)\\s*[:?]?\\s*$', 1)) AS art,
  list_transform(o, lambda x: lower(regexp_extract(x, '^\\s*([A-Za-z][A-Za-z\\-'']*)', 1))) AS fw,
  list_transform(o, lambda x: try_cast(replace(regexp_extract(x, '{tx.NUMBER}'), ',', '') AS DOUBLE)) AS vals,
  list_transform(o, lambda x: lower(x)) AS lo, list_transform(o, lambda x: {_sentence('x')}) AS sent FROM d3),
d5 AS (SELECT *, list_intersect(sw, kw) AS sh, list_avg(wc) AS mw, list_filter(vals, lambda v: v IS NOT NULL) AS vv,
  len(list_filter(nu, lambda x: x)) AS nn, len(list_filter(sent, lambda x: x)) AS ns,
  coalesce(list_max(list_transform(ow, lambda w: len(list_intersect(sw, w)) / greatest(len(w), 1))), 0) AS ovd,
  CASE WHEN len(ln) % 2 = 1 THEN ln[len(ln) // 2 + 1] ELSE (ln[len(ln) // 2] + ln[len(ln) // 2 + 1]) / 2 END AS med,
  list_filter(fw, lambda w: w <> '' AND (art = 'an') <> regexp_matches(w, '^[aeiou]')) AS bad FROM d4),
d6 AS (SELECT *, list_filter(sh, lambda w: NOT list_contains(flatten(ow), w)) AS ex, sqrt(list_avg(list_transform(wc, lambda x: (x - mw) * (x - mw)))) AS sd FROM d5),
flags AS (SELECT {_META}, rationale, st, o, oth, kt, lead, sw, kw, ow, low,
  (regexp_matches(asked, {_quote(detector.NEGATIVE_ASKED)}) OR regexp_matches(asked, {_quote(detector.NEGATIVE_SHOUTED)}))::INT AS negative_stem,
  ({_ANY(f"regexp_matches(x, {_quote(detector.NONE_OF)})")})::INT AS none_of_the_above,
  ({_ANY(f"regexp_matches(x, {_quote(detector.ALL_OF)})")})::INT AS all_of_the_above,
  ({_ANY(" OR ".join(f"regexp_matches(x, {_quote(p)})" for p in (detector.LETTERS_COMBINED, detector.ROMAN_COMBINED, detector.DIGITS_COMBINED)))})::INT AS combination_options,
  regexp_matches(st, {_quote(detector.BLANK)})::INT AS fill_in_blank,
  (regexp_matches(lead, {_quote(detector.TRUE_FALSE)}) OR len(list_filter(lo, lambda x: x NOT IN ('true', 'false', 'yes', 'no'))) = 0)::INT AS true_false_stem,
  (len(kt) > 1.25 * list_max(list_transform(oth, lambda x: len(x))) AND {_words('kt')} >= 4)::INT AS longest_option_key,
  ({_ANY(f"len(list_intersect({_tokens(_exempt('x'))}, {_list(detector.ABSOLUTE_TERMS)})) > 0")})::INT AS absolute_terms,
  ({_ANY(f"len(list_intersect({_tokens('x')}, {_list(detector.VAGUE_TERMS)})) > 0")})::INT AS vague_terms,
  (len(ex) > 0 AND (len(ex) >= 2 OR len(sh) / greatest(len(kw), 1) >= 2 * ovd))::INT AS clang_cue,
  ((art <> '' AND len(bad) BETWEEN 1 AND len(o) - 1) OR ({_sentence('kt')} AND len(list_filter(oth, lambda x: {_sentence('x')})) = 0))::INT AS grammatical_cue,
  ((nn >= 2 AND nn < len(o)) OR ns BETWEEN 1 AND len(o) - 1 OR (mw >= 3 AND sd / mw > 0.6))::INT AS nonparallel_options,
  (nn = len(o) AND vv <> list_sort(vv) AND vv <> list_reverse_sort(vv))::INT AS numeric_not_ordered,
  (len(list_filter(range(1, 26), lambda i: (i - 1) // 5 <> (i - 1) % 5 AND len(low[(i - 1) // 5 + 1]) >= 6 AND contains(low[(i - 1) % 5 + 1], low[(i - 1) // 5 + 1])
    AND regexp_matches(low[(i - 1) % 5 + 1], '(^|[^a-z0-9.])' || regexp_escape(low[(i - 1) // 5 + 1]) || '($|[^a-z0-9])'))) > 0)::INT AS overlapping_options,
  (med > 0 AND (len(list_filter(ln, lambda x: x > 1.75 * med)) = 1 OR (len(list_filter(ln, lambda x: x < med / 1.75)) = 1 AND med >= 12)))::INT AS option_length_outlier,
  (nn = len(o) AND len(list_distinct(list_transform(o, lambda x: lower(regexp_replace(regexp_extract(x, '^.*?{tx.NUMBER}(.*)$', 1), '[\\d\\s.,]', '', 'g'))))) > 1)::INT AS numeric_units_inconsistent,
  (nn = 0 AND lo <> list_sort(lo))::INT AS options_not_alphabetical,
  len(o)::INT AS n_options, key, {_words('st')}::INT AS stem_words, len(kt)::INT AS key_chars,
  round(list_avg(list_transform(oth, lambda x: len(x)::DOUBLE)), 1) AS mean_distractor_chars FROM d6),
full_flags AS (SELECT *, {' + '.join(RULES)} AS n_flaws, greatest({', '.join(RULES)}) AS any_flaw FROM flags),
main AS (SELECT *, (condition = 'guided')::INT AS guided, (tier = 'flagship')::INT AS flagship, (key = 'A')::INT AS key_a,
  specialty || ':' || topic_index AS topic FROM full_flags WHERE condition IN ('plain', 'guided') AND reasoning_mode = 'off')"""
