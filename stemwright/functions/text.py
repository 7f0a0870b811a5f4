"""Text primitives as Column functions; all of them run inside the JVM and treat NULL as the empty text where said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The dashes read as a hyphen.
DASHES = "‐‑‒–—−"

# Words that carry no content for the repetition rule.
STOP_WORDS = """a an the and or of to in on at for with by from as is are was were be been being this that these those
it its he she his her they them their which what who whom whose where when why how most likely following best next
step management appropriate diagnosis initial patient patients year years old man woman boy girl male female presents
presenting present comes brought because history physical examination shows show findings finding laboratory studies
study test results result likely cause causes causing mechanism treatment therapy would should could also than then
after before during over under between into within without about above below more less than other another some any
each such same only very also""".split()

# Generic clinical words that joined the list with version 1.1.
CLINICAL_STOP_WORDS = """serum blood level levels hour hours day days week weeks month months year years minute minutes small large multiple
normal abnormal oral intravenous fluid fluids cell cells symptom symptoms sign signs right left upper lower bilateral
medication medications drug drugs dose doses increase increased decrease decreased high low elevated reduced acute chronic
mild moderate severe primary secondary positive negative pain examination evaluation measurement first second immediate
urgent emergency department hospital admission discharge care therapy treatment repeat continue start begin obtain perform
administer measure recent history current daily weekly single double total complete partial major minor early late""".split()

# Fixed value: a number in an option.
NUMBER = r"[-+]?\d[\d,]*\.?\d*"


def norm(text: Column, fold_dashes: bool = True) -> Column:
    """One blank for each run of white space, none outside, dashes as hyphens; NULL gives ''."""
    text = F.coalesce(text, F.lit(""))
    if fold_dashes:
        text = F.translate(text, DASHES, "-" * len(DASHES))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def key_letter(answer: Column) -> Column:
    """The option letter A to J of a freely written key ('(c)', 'Option C', 'C.'); '' if it can't be read."""
    pattern = r"(?i)^\(?\s*(?:option|answer|choice)?\s*:?\s*\(?\s*([A-J])\s*[).:]?\s*\)?$"
    return F.upper(F.regexp_extract(F.trim(F.coalesce(answer, F.lit(""))), pattern, 1))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z\-']+)"), F.lit(1))


def words(text: Column) -> Column:
    """Non-empty parts between blanks."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def lemma(word: Column) -> Column:
    """Plural and verb endings cut by the first rule that applies."""
    n = F.length(word)

    def drop(k: int) -> Column:
        return F.substring(word, F.lit(1), n - k)

    return (
        F.when(word.endswith("ies") & (n >= 7), F.concat(drop(3), F.lit("y")))
        .when(word.rlike("(xes|ches|shes|sses|zes)$") & (n >= 6), drop(2))
        .when(word.endswith("s") & ~word.endswith("ss") & (n >= 5), drop(1))
        .when(word.endswith("ing") & (n >= 7), drop(3))
        .when(word.endswith("ed") & (n >= 6), drop(2))
        .otherwise(word)
    )


def lemma_first_version(word: Column) -> Column:
    """The endings of version 1.0: the first of ies, es, s, ing, ed that leaves four letters."""
    n = F.length(word)
    out = F.when(word.endswith("ies") & (n >= 7), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y")))
    for ending in ("es", "s", "ing", "ed"):
        k = len(ending)
        out = out.when(word.endswith(ending) & (n >= k + 4), F.substring(word, F.lit(1), n - k))
    return out.otherwise(word)


def plural_folded(word: Column) -> Column:
    """Plural endings only, of words longer than four letters."""
    n = F.length(word)
    return (
        F.when((n > 4) & word.endswith("ies"), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & word.rlike("(xes|ches|shes|sses|zes)$"), F.substring(word, F.lit(1), n - 2))
        .when((n > 4) & word.endswith("s") & ~word.endswith("ss"), F.substring(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def content_words(text: Column, version: str = "1.2", fold=None) -> Column:
    """Distinct lemmas of the words of four letters or more that aren't stop words."""
    stops = set(STOP_WORDS) | (set() if version == "1.0" else set(CLINICAL_STOP_WORDS))
    listed = F.array(*[F.lit(w) for w in sorted(stops) if len(w) >= 4])
    fold = fold or (lemma if version == "1.2" else lemma_first_version)
    bare = F.transform(tokens(text), lambda w: F.regexp_replace(w, "^[-']+|[-']+$", ""))
    kept = F.filter(bare, lambda w: (F.length(w) >= 4) & ~F.array_contains(listed, w))
    return F.array_distinct(F.transform(kept, fold))


def lead_in(stem: Column) -> Column:
    """The last sentence of a normalised stem that ends in '?' or ':', else the last sentence."""
    parts = F.split(stem, r"(?<=[.?!:])\s+")
    asking = F.filter(parts, lambda s: s.endswith("?") | s.endswith(":"))
    return F.when(F.size(asking) > 0, F.element_at(asking, -1)).otherwise(F.element_at(parts, -1))


def first_word(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([A-Za-z][A-Za-z\-']*)", 1)


def is_numeric(option: Column) -> Column:
    """Starts with a number and has at most 12 other characters beside digits, blanks and signs."""
    rest = F.regexp_replace(option, r"[\d\s.,%/:+\-–]", "")
    return option.rlike("^" + NUMBER) & (F.length(rest) <= 12)


def num_value(option: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(option, f"({NUMBER})", 1), ",", "").try_cast("double")


def unit(option: Column) -> Column:
    """What follows the first number, without digits, blanks, dots and commas, in lower case."""
    after = F.regexp_extract(option, f"^.*?{NUMBER}(.*)$", 1)
    return F.lower(F.regexp_replace(after, r"[\d\s.,]", ""))


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct runs of n words (a-z, 0-9) of the lower-cased text; fewer words give an empty set."""
    ws = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    joined = F.array_join(ws, " ")
    # Every run is cut from positions of one array; the array is bound once by the outer transform.
    bound = F.transform(F.array(F.split(joined, " ")), lambda a: F.when(
        F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.array_join(F.slice(a, i, n), " "))
    ).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.element_at(bound, 1))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


# Words that open a question or a request, and words that say nothing about which option a rationale means.
ASKING = ["which", "what", "who", "where", "when", "how", "why", "identify", "select", "choose"]
RATIONALE_STOP_WORDS = (
    "a an the and or of to in on at for with by from as is are was were be been this that these those it its he she his her they them "
    "their which what who most likely following best next step management appropriate diagnosis initial patient patients treatment "
    "therapy would should could than then after before during over under between into within without about above below more less other "
    "some any each such same only very also because due given has have had not no option options answer correct incorrect choice"
).split()


def has_lead_in(stem: Column) -> Column:
    """Whether a stem asks for something: a '?' anywhere, a ':' at the end, an end without any of . ? ! :, or a sentence that opens by asking."""
    s = F.trim(F.regexp_replace(F.coalesce(stem, F.lit("")), r"(?U)\s+", " "))
    return s.contains("?") | ~s.rlike("[.!?]$") | s.rlike(r"(?i)(^|[.?!:]\s+)(" + "|".join(ASKING) + r")\b")


def letter_mentions(text: Column) -> Column:
    """Option letters a rationale names after option, choice, answer, 'answer is' or alternative (a colon or bracket may follow), or in brackets, in either case."""
    found = F.regexp_extract_all(
        F.coalesce(text, F.lit("")), F.lit(r"(?i)(\b(?:option|choice|answer(?: is)?|alternative)\s*[:(]?\s*[A-E]\b|\([A-E]\))"), F.lit(1)
    )
    return F.array_distinct(F.transform(found, lambda x: F.upper(F.regexp_extract(x, r"(?i)([A-E])\)?$", 1))))


def rationale_words(text: Column) -> Column:
    """Different words of four letters or more that say something about the content."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z][a-z\-']{3,})"), F.lit(1))
    return F.array_except(words, F.array(*[F.lit(w) for w in RATIONALE_STOP_WORDS if len(w) >= 4]))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def hash_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)


def percent_half_up(k: Column, n: Column) -> Column:
    return F.when(n > 0, F.round(k.cast("decimal(20,0)") * 100 / n.cast("decimal(20,0)"), 0).cast("long"))
