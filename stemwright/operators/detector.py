"""Item-writing flaws as Column expressions: one rule module for the released versions 1.0, 1.1 and 1.2.

Input rows hold stem, answer and options (array of structs l, t). All derived texts are materialised as
columns first, since expressions inside array lambdas aren't shared. NULL texts count as empty, NULL or
unreadable keys switch the key rules off, option letters that collide keep the last text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemwright.functions import text as tx

# Names of the 14 rules, of the three features, and the composites.
RULES = [
    "negative_stem", "none_of_the_above", "all_of_the_above", "combination_options", "fill_in_blank", "true_false_stem",
    "longest_option_key", "absolute_terms", "vague_terms", "clang_cue", "grammatical_cue", "nonparallel_options",
    "numeric_not_ordered", "overlapping_options",
]
FEATURES = ["option_length_outlier", "numeric_units_inconsistent", "options_not_alphabetical"]
FLAGS = RULES + FEATURES
VALIDATED = [
    "negative_stem", "none_of_the_above", "all_of_the_above", "combination_options", "fill_in_blank", "absolute_terms",
    "vague_terms", "clang_cue", "grammatical_cue", "numeric_not_ordered",
]
SENSITIVITY = [r for r in RULES if r not in ("absolute_terms", "vague_terms", "grammatical_cue")]
CUEING = ["longest_option_key", "absolute_terms", "clang_cue", "grammatical_cue"]
COMPOSITES = {"core14": RULES, "validated10": VALIDATED, "sensitivity11": SENSITIVITY, "cueing4": CUEING}

# Word lists.
ABSOLUTE_TERMS = "always never all none only every completely absolutely totally definitely impossible invariably entirely exclusively".split()
VAGUE_TERMS = "usually often frequently sometimes rarely seldom occasionally generally regularly infrequently commonly".split()

# Phrases in which an absolute word is idiomatic.
ABSOLUTE_EXEMPT = [
    r"every (other )?(day|night|morning|evening|afternoon|bedtime|meal|dose|visit|week|month|year|hour|\d+ (hours|days|weeks|months|years))",
    r"all of the above", r"none of the above", r"all-cause", r"all-trans", r"once daily", r"only child", r"every \d+",
    r"\bonly (a |an |one |two |three |four |five |few |\d+)", r"\ball (but|of|three|four|five|\d+)\b",
    r"\bnone of (the|these)\b", r"\bat all\b",
]
ABSOLUTE_EXEMPT_BEFORE = [
    r"every (other )?(day|week|month|year|hour|\d+ (hours|days|weeks))", r"all of the above", r"none of the above",
    r"all-cause", r"all-trans", r"once daily", r"only child", r"every \d+",
    r"\bonly (a |an |one |two |three |four |five |few |\d+)", r"\ball (but|of the|of these|three|four|five|\d+)\b",
    r"\bnone of (the|these)\b", r"\bat all\b", r"\ball\b(?=.*\bof\b)",
]
# Patterns of the lead-in.
NEGATED = (
    r"not\s+(a|an|the|be|associated|recommended|indicated|characteristic|consistent|expected|likely|true|correct|"
    r"part|included|appropriate|typically|usually|generally|considered|known|used|caused|seen|found|contraindicated|"
    r"required|require|needed|need|improved?|increased?|decreased?)\b"
)
NEGATIVE_ASKED = (
    r"(?i)(\b(which|what|who|where|all|each)\b[^.?!]*\b(" + NEGATED + r"|except|least|false|incorrect|never)\b)"
    r"|(\b(is|are|was|were|does|do|did|would|should|could|can|will|has|have)\s+" + NEGATED + r"[^.?!]*\?)|(\bexcept\b\s*[:?]?\s*$)"
)
NEGATIVE_SHOUTED = r"\b(NOT|EXCEPT|LEAST|FALSE|INCORRECT)\b"
NEGATIVE_ASKED_FIRST = (
    r"(\b(which|what|who|where|all|each)\b[^.?!]*\b(not|except|least|false|incorrect|never)\b)"
    r"|(\b(is|are|was|were|does|do|did|would|should|could|can|will|has|have)\s+not\b[^.?!]*\?)|(\bexcept\b\s*[:?]?\s*$)"
)
TRUE_FALSE = r"(?i)\bwhich (of the following )?(statement|statements)?\s*(is|are)\s*(true|correct|false|incorrect|accurate)\b"
BLANK = r"(?i)_{2,}|\[blank\]|\(blank\)"
# Patterns of the options.
ALL_OF = r"(?i)\ball of (the )?(above|these|them)\b|\ball (options|choices) (are|apply)\b"
NONE_OF = r"(?i)\bnone of (the )?(above|these|them)\b|\bneither of (the )?(above|these)\b"
_N = "(I|II|III|IV|V)"
LETTERS_COMBINED = r"(?i)^\s*(both\s+)?[A-J](\s*,\s*[A-J])*\s*(,?\s*(and|or|&)\s*[A-J])\s*(only)?\s*$"
DIGITS_COMBINED = r"(?i)^\s*(both\s+)?[1-9](\s*,\s*[1-9])*\s*(,?\s*(and|or|&)\s*[1-9])\s*(only)?\s*$"
ROMAN_COMBINED = (
    rf"(?i)^\s*(both\s+)?{_N}((\s*,\s*{_N})+\s*(,?\s*(and|or|&)\s*{_N})?|\s*,?\s*(and|or|&)\s*{_N})\s*(only)?\s*$"
)
ROMAN_COMBINED_BEFORE = rf"^\s*{_N}(\s*,\s*{_N})*\s*(,?\s*(and|or|&)\s*{_N})?\s*(only)?\s*$"


@dataclass(frozen=True)
class Thresholds:
    longest_ratio: float = 1.25
    longest_min_words: int = 4
    outlier_ratio: float = 1.75
    nonparallel_cv: float = 0.60


def options_of(columns: dict[str, str]) -> Column:
    """Array of (l, t) from one column for each letter; NULL options are left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("l"), F.col(c).alias("t")) for k, c in columns.items()])
    return F.filter(pairs, lambda o: o["t"].isNotNull())


def with_options(items: DataFrame, fold_dashes: bool) -> DataFrame:
    """items with `_o`: letters in upper case, texts normalised, the last of equal letters, in order of the letter."""
    tidy = F.transform(
        F.coalesce(F.col("options"), F.array().cast("array<struct<l:string,t:string>>")),
        lambda o: F.struct(F.substring(F.upper(F.trim(o["l"])), 1, 1).alias("l"), tx.norm(o["t"], fold_dashes).alias("t")),
    )
    backwards = F.reverse(F.transform("_o", lambda o: o["l"]))
    return (
        items.withColumn("_o", tidy).withColumn("_b", backwards)
        .withColumn("_o", F.array_sort(F.filter("_o", lambda o, i: F.size("_b") - F.array_position("_b", o["l"]) == i)))
        .drop("_b")
    )


def _exempted(option: Column, version: str) -> Column:
    text = F.lower(option)
    for pattern in ABSOLUTE_EXEMPT if version == "1.2" else ABSOLUTE_EXEMPT_BEFORE:
        text = F.regexp_replace(text, pattern, " ")
    return text


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _is_sentence(option: Column) -> Column:
    return option.endswith(".") & (F.size(tx.words(option)) >= 4)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _some_not_all(flags: Column) -> Column:
    n = F.size(F.filter(flags, lambda x: x))
    return (n > 0) & (n < F.size(flags))


def prepared(items: DataFrame, version: str = "1.2") -> DataFrame:
    """items with the derived columns the rules read (names begin with an underscore)."""
    folded = version == "1.2"
    answer = F.col("answer")
    key = tx.key_letter(answer) if folded else F.substring(F.upper(F.trim(F.coalesce(answer, F.lit("")))), 1, 1)
    df = with_options(items, folded).withColumns({"_stem": tx.norm(F.col("stem"), folded), "_key": key})
    df = df.withColumns(
        {
            "_texts": F.transform("_o", lambda o: o["t"]),
            "_keys": F.filter("_o", lambda o: o["l"] == F.col("_key")),
            "_others": F.transform(F.filter("_o", lambda o: o["l"] != F.col("_key")), lambda o: o["t"]),
            "_lead": tx.lead_in(F.col("_stem")),
        }
    )
    df = df.withColumns(
        {
            "_has_key": F.size("_keys") > 0,
            "_key_text": F.coalesce(F.get("_keys", F.lit(0))["t"], F.lit("")),
            "_stem_words": tx.content_words(F.col("_stem"), version),
            "_other_words": F.transform("_others", lambda d: tx.content_words(d, version)),
            "_numeric": F.transform("_texts", tx.is_numeric),
            "_low": F.transform("_texts", lambda t: F.lower(t) if version != "1.2" else F.regexp_replace(F.lower(t), "^[ .;:,]+|[ .;:,]+$", "")),
            "_lengths": F.array_sort(F.transform("_texts", F.length)),
            "_counts": F.transform("_texts", lambda t: F.greatest(F.size(tx.words(t)), F.lit(1)).cast("double")),
        }
    )
    return df.withColumns(
        {
            "_key_words": tx.content_words(F.col("_key_text"), version),
            "_values": F.filter(F.transform("_texts", tx.num_value), lambda v: v.isNotNull()),
            "_mean_words": F.aggregate("_counts", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("_counts"), F.lit(1)),
            "_absolute": F.transform("_texts", lambda t: F.array_intersect(tx.tokens(_exempted(t, version)), _strings(ABSOLUTE_TERMS))),
        }
    ).withColumns(
        {
            "_shared": F.array_intersect("_stem_words", "_key_words"),
            "_overlaps": F.transform(
                "_other_words",
                lambda w: F.size(F.array_intersect("_stem_words", w)) / F.greatest(F.size(w), F.lit(1)).cast("double"),
            ),
            "_spread": F.sqrt(
                F.aggregate("_counts", F.lit(0.0), lambda a, x: a + (x - F.col("_mean_words")) * (x - F.col("_mean_words"))) / F.greatest(F.size("_counts"), F.lit(1))
            ),
        }
    ).withColumn("_exclusive", F.array_except("_shared", F.flatten("_other_words")))


def rule_columns(version: str = "1.2", at: Thresholds = Thresholds()) -> dict[str, Column]:
    """Boolean Columns of the 14 rules and three features over a prepared() frame."""
    lead, texts, n = F.col("_lead"), F.col("_texts"), F.size("_texts")
    asked = F.regexp_replace(lead, r"(?i)\bat least\b|\bnot only\b", " ")
    negative = (asked.rlike(NEGATIVE_ASKED) | asked.rlike(NEGATIVE_SHOUTED)) if version != "1.0" else (
        lead.rlike(NEGATIVE_SHOUTED) | lead.rlike(NEGATIVE_ASKED_FIRST)
    )
    truths = _strings(["true", "false", "yes", "no"])
    roman = ROMAN_COMBINED if version == "1.2" else ROMAN_COMBINED_BEFORE

    def combined(o: Column) -> Column:
        found = o.rlike(LETTERS_COMBINED) | o.rlike(roman)
        return found | o.rlike(DIGITS_COMBINED) if version != "1.0" else found

    combination = F.exists(texts, combined)
    if version == "1.0":
        pieces = F.flatten(F.transform(texts, lambda o: F.array_distinct(F.filter(
            F.transform(F.split(o, r",|\band\b|&"), lambda p: F.lower(F.trim(p))), lambda p: p != ""))))
        joined = F.size(F.filter(texts, lambda o: o.rlike(r"\b(and|&)\b")))
        combination = combination | ((joined >= 2) & (F.size(pieces) - F.size(F.array_distinct(pieces)) >= 2))

    longest_other = F.array_max(F.transform("_others", F.length))
    key_len = F.length("_key_text")
    longest = (
        F.col("_has_key") & (F.size("_others") > 0) & (key_len > at.longest_ratio * longest_other)
        & (F.size(tx.words(F.col("_key_text"))) >= at.longest_min_words)
    )
    ov_key = F.size("_shared") / F.greatest(F.size("_key_words"), F.lit(1)).cast("double")
    ov_other = F.coalesce(F.array_max("_overlaps"), F.lit(0.0))
    clang = F.col("_has_key") & (F.size("_exclusive") > 0) & ((F.size("_exclusive") >= 2) | (ov_key >= 2 * ov_other))

    article = F.lower(F.regexp_extract(F.trim(lead), r"(?i)\b(an|a)\s*[:?]?\s*$", 1))
    wrong = F.filter(texts, lambda o: (tx.first_word(o) != "") & (
        (article == "an") != F.lower(tx.first_word(o)).rlike("^[aeiou]")))
    by_article = (article != "") & (F.size(wrong) > 0) & (F.size(wrong) < n)
    others_sentence = F.exists("_others", _is_sentence)
    if version == "1.0":
        forms = [
            lambda o: o.endswith("."),
            lambda o: F.lower(tx.first_word(o)).endswith("ing"),
            lambda o: F.coalesce(F.get(tx.words(o), F.lit(0)), F.lit("")).rlike(r"\b\w+s\b$"),
        ]
        alone = reduce(
            lambda a, b: a | b,
            [F.forall("_others", (lambda f: lambda o: f(o) != f(F.col("_key_text")))(f)) for f in forms],
        )
        by_form = F.col("_has_key") & (n >= 3) & alone
    else:
        by_form = F.col("_has_key") & (n >= 3) & _is_sentence(F.col("_key_text")) & ~others_sentence

    n_numeric = F.size(F.filter("_numeric", lambda x: x))
    uneven = (F.col("_mean_words") >= 3) & (F.try_divide("_spread", "_mean_words") > at.nonparallel_cv)
    nonparallel = (n >= 3) & (
        ((n_numeric >= 2) & (n_numeric < n)) | _some_not_all(F.transform(texts, _is_sentence)) | uneven
    )
    all_numeric = (n >= 3) & (n_numeric == n)
    up = F.array_sort("_values")
    unordered = all_numeric & (F.col("_values") != up) & (F.col("_values") != F.reverse(up))

    low = F.col("_low")

    def contained(a: Column, b: Column, i: Column, j: Column) -> Column:
        held = (i != j) & (F.length(a) >= 6) & b.contains(a)
        if version == "1.0":
            return held
        return held & F.rlike(b, F.concat(F.lit("(?<![a-z0-9.])"), _quoted(a), F.lit("(?![a-z0-9])")))

    places = F.transform(low, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    overlapping = F.exists(places, lambda a: F.exists(places, lambda b: contained(a["t"], b["t"], a["i"], b["i"])))

    lengths, half = F.col("_lengths"), F.floor(n / 2).cast("int")
    median = F.when(n % 2 == 1, F.get(lengths, half).cast("double")).otherwise((F.get(lengths, half - 1) + F.get(lengths, half)) / 2)
    long_out = F.size(F.filter(lengths, lambda x: x > at.outlier_ratio * median))
    short_out = F.size(F.filter(lengths, lambda x: x < median / at.outlier_ratio))
    outlier = (n >= 3) & (median > 0) & ((long_out == 1) | ((short_out == 1) & (median >= 12)))
    lowered = F.transform(texts, F.lower)
    columns = {
        "negative_stem": negative,
        "none_of_the_above": F.exists(texts, lambda o: o.rlike(NONE_OF)),
        "all_of_the_above": F.exists(texts, lambda o: o.rlike(ALL_OF)),
        "combination_options": combination,
        "fill_in_blank": F.col("_stem").rlike(BLANK),
        "true_false_stem": (n > 0) & (lead.rlike(TRUE_FALSE) | F.forall(texts, lambda o: F.array_contains(truths, F.lower(o)))),
        "longest_option_key": longest,
        "absolute_terms": F.exists("_absolute", lambda a: F.size(a) > 0),
        "vague_terms": F.exists(texts, lambda o: F.arrays_overlap(tx.tokens(o), _strings(VAGUE_TERMS))),
        "clang_cue": clang,
        "grammatical_cue": (n > 0) & (by_article | by_form),
        "nonparallel_options": nonparallel,
        "numeric_not_ordered": unordered,
        "overlapping_options": overlapping,
        "option_length_outlier": outlier,
        "numeric_units_inconsistent": all_numeric & (F.size(F.array_distinct(F.transform(texts, tx.unit))) > 1),
        "options_not_alphabetical": (n_numeric == 0) & (n >= 3) & (lowered != F.array_sort(lowered)),
    }
    return {k: F.coalesce(c, F.lit(False)) for k, c in columns.items()}


def detect(items: DataFrame, version: str = "1.2", at: Thresholds = Thresholds(), keep: list[str] | None = None) -> DataFrame:
    """items with the 17 flags (0 or 1) and the features; `keep` names the input columns to carry (default all but the texts)."""
    carried = keep if keep is not None else [c for c in items.columns if c not in ("options", "answer")]
    flagged = prepared(items, version).withColumns({k: c.cast("int") for k, c in rule_columns(version, at).items()})
    total = reduce(lambda a, b: a + b, [F.col(r) for r in RULES])
    mean_other = F.aggregate("_others", F.lit(0.0), lambda a, x: a + F.length(x)) / F.greatest(F.size("_others"), F.lit(1))
    return flagged.select(
        *carried, *FLAGS, total.alias("n_flaws"), F.size("_texts").alias("n_options"), F.col("_key").alias("key"),
        F.size(tx.words(F.col("_stem"))).alias("stem_words"), F.length("_key_text").alias("key_chars"),
        F.when(F.size("_others") > 0, F.round(mean_other, 1)).alias("mean_distractor_chars"),
        F.lit(version).alias("detector_version"),
    )


def evidence(items: DataFrame, version: str = "1.2") -> DataFrame:
    """What the rules fired on: words, lengths and the ratio behind the flags, as typed columns."""
    longest_other = F.array_max(F.transform("_others", F.length))
    hits = F.filter(F.transform("_o", lambda o, i: F.struct(o["l"].alias("l"), F.array_sort(F.array_distinct(F.get("_absolute", i))).alias("words"))), lambda h: F.size(h["words"]) > 0)
    vague = F.filter(
        F.transform("_o", lambda o: F.struct(o["l"].alias("l"), F.array_sort(F.array_intersect(tx.tokens(o["t"]), _strings(VAGUE_TERMS))).alias("words"))),
        lambda h: F.size(h["words"]) > 0,
    )
    base = [c for c in items.columns if c not in ("options", "answer")]
    return prepared(items, version).select(
        *base, F.col("_lead").alias("lead_in"), F.transform("_texts", F.length).alias("option_chars"),
        F.round(F.try_divide(F.length("_key_text"), longest_other), 2).alias("key_to_longest_distractor_ratio"),
        hits.alias("absolute_hits"), vague.alias("vague_hits"), F.array_sort("_exclusive").alias("clang_words"),
    )


def any_flaw(rules: list[str]) -> Column:
    return F.greatest(*[F.col(r) for r in rules])


def n_flaws(rules: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(r) for r in rules])
