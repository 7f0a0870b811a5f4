"""Text decoded with the wrong code page: a substitution cipher, broken by expectation-maximisation.

A cipher unit is what one character of the original may have become: a longer run (bytes of UTF-8 read
one by one) or one foreign character (one code page read as another). The hidden state is the swap of
each document; a swap maps units to letters. Letters are judged by the character pairs of the whole
corpus: how often a letter follows the left neighbour and precedes the right one. Each round the
E-step gives every document its most probable swap, and the M-step counts the character pairs again,
with the units of garbled documents read as their letters, and the share of each swap in each source.

Swaps of known code pages are starting points only. For what they leave, a mapping is learned for each
source: a unit (a run of one to three foreign characters) is given the letter whose neighbours its own
resemble, if documents that hold it hold hardly any letter of the alphabet; documents and the units' odds
are then estimated in turn.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemwright.session import cut

READ_AS = ["cp1252", "latin-1", "cp437", "cp850", "cp1251", "cp1250", "cp1253", "cp1254", "mac-roman", "koi8-r", "cp866"]
WRITTEN_AS = ["cp437", "cp850", "mac-roman"]
LOST = "�"
SMOOTH, TOTAL = 0.1, 20.0  # added to pair counts and to letter counts
LEAST_GAIN = 5.0  # log odds below which a unit says nothing for a swap
RUN_PRIOR = 7.0  # log odds that a run of just the right characters isn't chance


def _decode(data: bytes, page: str) -> str:
    """Bytes without a character in the page stay control characters, as lenient readers leave them."""
    out = []
    for value in data:
        try:
            out.append(bytes([value]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(value))
    return "".join(out)


@lru_cache(maxsize=1)
def swaps() -> dict[str, dict[str, str]]:
    """Name of a swap -> its units and their letters, for all letters of the western code page."""
    letters = [c for v in range(0x80, 0x100) if (c := _decode(bytes([v]), "cp1252")).isprintable() or c == "\xa0"]
    out: dict[str, dict[str, str]] = {}
    for page in READ_AS:
        out[f"utf-8>{page}"] = {_decode(c.encode(), page): c for c in letters + list("≥≤−…•™≠≈")}
        if page != "cp1252":
            out[f"cp1252>{page}"] = {u: c for c in letters if len(u := _decode(c.encode("cp1252", "ignore"), page)) == 1 and u != c}
    for page in WRITTEN_AS:
        pairs = ((_decode(c.encode(page, "ignore"), "cp1252"), c) for c in letters)
        out[f"{page}>cp1252"] = {u: c for u, c in pairs if len(u) == 1 and u != c}
    for page in ("cp1252", "latin-1", "cp850", "mac-roman", "cp1251"):
        out[f"utf-8>{page} twice"] = {_decode(u.encode(), page): c for u, c in out[f"utf-8>{page}"].items()}
    out["utf-8>cp1252>cp1251"] = {_decode(u.encode(), "cp1251"): c for u, c in out["utf-8>cp1252"].items()}
    return {k: {u: c for u, c in v.items() if u and not u.isascii()} for k, v in out.items() if v}


@lru_cache(maxsize=1)
def _runs() -> tuple[frozenset[str], int]:
    runs = frozenset(u for v in swaps().values() for u in v if len(u) > 1)
    return runs, max(map(len, runs))


_FOREIGN = re.compile("[^\x00-\x7f]+")


def units(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the units of a text, the longest at each place."""
    runs, longest = _runs()
    for m in _FOREIGN.finditer(text):
        at, end = m.span()
        while at < end:
            size = next((k for k in range(min(longest, end - at), 1, -1) if text[at : at + k] in runs), 1)
            yield at, at + size
            at += size


def _neighbour(c: str) -> str:
    if not c or c.isspace() and c != "\xa0":
        return " "
    return "0" if c.isdigit() else c if c.isascii() else "*"


def unit_counts(text: str) -> Counter[tuple[str, str, str]]:
    """(unit, left, right) of a text; digits are one neighbour, so are blanks and all other foreign characters."""
    return Counter(
        (text[a:b], _neighbour(text[a - 1 : a] if a else ""), _neighbour(text[b : b + 1])) for a, b in units(text)
    )


class PairModel:
    """Counts of letters with their neighbours, and the gain of reading a unit as another letter."""

    def __init__(self, counts: dict[tuple[str, str, str], float]):
        self.one: Counter[str] = Counter()
        self.left: Counter[tuple[str, str]] = Counter()
        self.right: Counter[tuple[str, str]] = Counter()
        for (u, left, right), n in counts.items():
            self.one[u] += n
            self.left[u, left] += n
            self.right[u, right] += n

    def score(self, u: str, left: str, right: str) -> float:
        pair = (self.left[u, left] + SMOOTH) * (self.right[u, right] + SMOOTH)
        return float(np.log(pair / (self.one[u] + TOTAL)))

    def gains(self, places: list[tuple[str, str, str]], least: float = LEAST_GAIN) -> dict[tuple[str, str, str], list[tuple[str, float]]]:
        """For each unit in its place the swaps that explain it better than itself, with the log odds gained."""
        readers: dict[str, list[tuple[str, str]]] = {}
        for name, mapping in swaps().items():
            for u, c in mapping.items():
                readers.setdefault(u, []).append((name, c))
        out = {}
        for place in places:
            u, left, right = place
            own = self.score(u, left, right)
            found = []
            for name, c in readers.get(u, ()):
                gain = self.score(c, left, right) - own + (RUN_PRIOR if len(u) > 1 else 0.0)
                if gain > least:
                    found.append((name, gain))
            if found:
                out[place] = found
        return out


def document_swap(places: list[tuple[str, str, str]], n: list[int], gains: dict, priors: dict[str, float]) -> tuple[str, float]:
    """The most probable swap of a document ('' for none) and its log odds against none.

    Part of a text may be garbled, so only units that gain count for a swap; its prior stands against it.
    """
    sums: Counter[str] = Counter()
    for place, k in zip(places, n):
        for name, gain in gains.get(place, ()):
            sums[name] += gain * min(k, 5)
    best, odds = "", 0.0
    for name, gain in sums.items():
        value = gain + priors.get(name, -7.0)
        if value > odds:
            best, odds = name, value
    return best, odds


def restored(text: str, mapping: dict[str, str], kept: frozenset[str]) -> str:
    """The text with units of the swap read as their letters, longest first; single characters by translate()."""
    runs = sorted((u for u in mapping if len(u) > 1), key=lambda u: (-len(u), u))
    if runs:
        text = re.sub("|".join(map(re.escape, runs)), lambda m: mapping[m.group()], text)
    return text.translate({ord(u): c for u, c in mapping.items() if len(u) == 1 and u not in kept})


def run_counts(text: str) -> Counter[tuple[str, str, str]]:
    """(run, left, right) of the runs of one to three foreign characters of a text."""
    return Counter(
        (m.group(), _neighbour(text[m.start() - 1 : m.start()] if m.start() else ""), _neighbour(text[m.end() : m.end() + 1]))
        for m in _FOREIGN.finditer(text) if m.end() - m.start() <= 3
    )


class Cipher:
    """The learned mapping of each source: unit -> (letter, log odds that a document with the unit is garbled)."""

    LEAST_DOCS = 5  # documents of a source a unit must be in before it is judged

    def __init__(self) -> None:
        self.units: dict[str, dict[str, tuple[str, float]]] = {}
        self.usual: frozenset[str] = frozenset()
        self.alphabet: frozenset[str] = frozenset()

    def learn(
        self, letters: dict[tuple[str, str, str], float], docs: dict[tuple[str, str], int], beside: dict[tuple[str, str, str], int],
        share: dict[tuple[str, str], float], places: dict[tuple[str, str], Counter],
    ) -> None:
        """letters: (letter, left, right) counts of all documents; docs: (source, unit) -> documents with the unit; beside: (source, unit,
        letter) -> those of them that hold the letter too; share: (source, letter) -> share of the source's documents that hold it;
        places: (source, unit) -> its (left, right) counts."""
        left, right, one, all_left, all_right = Counter(), Counter(), Counter(), Counter(), Counter()
        for (c, a, b), n in letters.items():
            if c in self.alphabet:
                one[c] += n
                left[c, a] += n
                right[c, b] += n
                all_left[a] += n
                all_right[b] += n
        base = sum(one.values()) or 1

        def likeness(c: str, a: str, b: str) -> float:
            """Log odds of the neighbours beside this letter against beside any letter."""
            pa, pb = (all_left[a] + 1.0) / (base + 40.0), (all_right[b] + 1.0) / (base + 40.0)
            return float(np.log((left[c, a] + 8 * pa) / ((one[c] + 8) * pa)) + np.log((right[c, b] + 8 * pb) / ((one[c] + 8) * pb)))

        options: list[tuple[float, str, str, str]] = []
        for (source, unit), held in docs.items():
            if set(unit) <= self.usual or any(c in self.alphabet for c in unit):
                continue
            around = places[source, unit]
            n = sum(around.values())
            if sum(k for (a, _), k in around.items() if a.isalpha()) < 0.3 * n:  # a mark before words, no letter
                continue
            for c in self.alphabet:
                usual, both = share.get((source, c), 0.0), beside.get((source, unit, c), 0)
                # A misread letter is missing from the documents that hold the unit in its place.
                if c != unit and usual > 0.05 and both <= 0.25 * usual * held and held * usual - both > 2.0:
                    fit = sum(k * likeness(c, a, b) for (a, b), k in around.items())
                    if fit > max(4.0, 0.4 * n):
                        options.append((fit, source, unit, c))
        taken: set[tuple[str, str]] = set()
        for _, source, unit, c in sorted(options, reverse=True):  # a cipher gives each letter to one unit, the surest first
            if unit not in self.units.get(source, {}) and (source, c) not in taken:
                self.units.setdefault(source, {})[unit] = (c, 2.5)
                taken.add((source, c))

    def verdict(self, source: str, runs: list[str], n: list[int]) -> float:
        """Log odds that a document with these runs is garbled: units speak for it, letters that they stand for against."""
        units = self.units.get(source, {})
        own = sum(units[r][1] for r in set(runs) if r in units)
        if own <= 0:
            return 0.0
        meant = {c for c, _ in units.values()}
        foes = sum(k for r, k in zip(runs, n) if r in meant and r not in units)
        return own - 0.7 * foes - 1.5

    def mapping(self, source: str) -> dict[str, str]:
        return {u: c for u, (c, odds) in self.units.get(source, {}).items() if odds > 0}


def _unit_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counted, runs = [unit_counts(t) for t in batch["text"]], [run_counts(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"], "source": batch["source"],
                    "places": [["\t".join(p) for p in c] for c in counted], "n": [list(c.values()) for c in counted],
                    "runs": [["\t".join(p) for p in c] for c in runs], "k": [list(c.values()) for c in runs],
                }
            )

    foreign = docs.filter(F.col("text").rlike("[^\\x00-\\x7f]"))
    return foreign.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, places array<string>, n array<int>, runs array<string>, k array<int>")


def _assigned(rows: DataFrame, gains: dict, priors: dict[str, dict[str, float]]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((gains, priors))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, weights = shared.value
        for batch in batches:
            swap, odds = [], []
            for source, places, n in zip(batch["source"], batch["places"], batch["n"]):
                split = [tuple(p.split("\t")) for p in places]
                best, value = document_swap(split, list(n), found, weights.get(source or "", {}))
                lost = any(p[0] == LOST for p in split)
                swap.append("lost" if lost and not best else best)
                odds.append(value)
            yield batch.assign(swap=swap, log_odds=odds)

    kept = "doc_id long, source string, places array<string>, n array<int>, runs array<string>, k array<int>"
    return rows.mapInPandas(run, f"{kept}, swap string, log_odds double")


def _learned(assigned: DataFrame, letters: dict[tuple[str, str, str], float], rounds: int = 2) -> tuple[DataFrame, Cipher]:
    """(assigned with the documents that learned mappings explain, the mappings)."""
    spark, cipher = assigned.sparkSession, Cipher()
    rest = assigned.filter("swap = ''").select(F.col("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.transform("runs", lambda p: F.split(p, "\t")).alias("s"), "k")
    each = rest.select("doc_id", "source", F.explode(F.arrays_zip("s", "k")).alias("p")).select(
        "doc_id", "source", F.get("p.s", F.lit(0)).alias("unit"), F.get("p.s", F.lit(1)).alias("l"), F.get("p.s", F.lit(2)).alias("r"), F.col("p.k").alias("n")
    )
    # Usual characters have a five-hundredth of all in a third of the sources, two at least, so that one source's misreadings are none of them; their letters are the alphabet.
    by_source: dict[str, Counter] = {}
    for r in each.filter(F.length("unit") == 1).groupBy("source", "unit").agg(F.sum("n").alias("n")).toLocalIterator():
        by_source.setdefault(r.source, Counter())[r.unit] += r.n
    usual = Counter(c for counts in by_source.values() for c, n in counts.items() if n >= 0.002 * sum(counts.values()))
    cipher.usual = frozenset(c for c, k in usual.items() if k >= max(min(2, len(by_source)), len(by_source) / 3))
    cipher.alphabet = frozenset(c for c in cipher.usual if c.isalpha())
    if not cipher.alphabet:
        return assigned, cipher
    known = F.array(*[F.lit(c) for c in sorted(cipher.alphabet)])
    units = each.select("doc_id", "source", "unit").distinct()
    per_unit = units.groupBy("source", "unit").agg(F.count("*").alias("docs"))
    sizes = {r.source: r.n for r in rest.groupBy("source").agg(F.count("*").alias("n")).toLocalIterator()}
    frequent = cut(per_unit.filter(F.col("docs") >= Cipher.LEAST_DOCS), "frequent-units")
    docs, share = {}, {}
    for r in frequent.toLocalIterator():  # units of LEAST_DOCS documents of a source or more
        docs[r.source, r.unit] = r.docs
        if r.unit in cipher.alphabet:
            share[r.source, r.unit] = r.docs / sizes[r.source]
    docs = {key: n for key, n in docs.items() if key[1] not in cipher.alphabet}
    own = rest.select("doc_id", F.array_intersect(F.array_distinct(F.transform("s", lambda p: F.get(p, F.lit(0)))), known).alias("own"))
    strange = frequent.filter(~F.col("unit").isin(sorted(cipher.alphabet))).select("source", "unit")
    pairs = units.join(strange, ["source", "unit"]).join(own, "doc_id").select("source", "unit", F.explode("own").alias("c")).groupBy("source", "unit", "c").agg(F.count("*").alias("n"))
    beside = {(r.source, r.unit, r.c): r.n for r in pairs.toLocalIterator()}
    places: dict[tuple[str, str], Counter] = {key: Counter() for key in docs}
    around = each.join(strange, ["source", "unit"]).groupBy("source", "unit", "l", "r").agg(F.sum("n").alias("n"))
    for r in around.toLocalIterator():
        places[r.source, r.unit][r.l, r.r] += r.n
    cipher.learn(letters, docs, beside, share, places)
    if not cipher.units:
        return assigned, cipher
    kept = "doc_id long, source string, places array<string>, n array<int>, runs array<string>, k array<int>, swap string, log_odds double"
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(cipher)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                odds = [shared.value.verdict(s or "", [p.split("\t")[0] for p in runs], list(k)) for s, runs, k in zip(batch["source"], batch["runs"], batch["k"])]
                hit = np.array(odds) > 0
                yield batch.assign(swap=np.where((batch["swap"] == "") & hit, "learned", batch["swap"]), log_odds=np.where((batch["swap"] == "") & hit, odds, batch["log_odds"]))

        out = cut(assigned.mapInPandas(run, kept), "learned")
        if turn == rounds - 1:
            return out, cipher
        # The units' odds from the documents as they are now judged.
        now = out.filter("swap in ('', 'learned')").select(F.coalesce("source", F.lit("")).alias("source"), "swap", F.explode(F.array_distinct(F.transform("runs", lambda p: F.element_at(F.split(p, "\t"), 1)))).alias("unit"))
        table = now.groupBy("source", "unit").agg(F.count_if(F.col("swap") == "learned").alias("g"), F.count("*").alias("n")).filter("g > 0")
        for r in table.toLocalIterator():
            unit = cipher.units.get(r.source, {}).get(r.unit)
            if unit:
                cipher.units[r.source][r.unit] = (unit[0], float(np.log((r.g + 0.5) / (r.n - r.g + 0.5))))
    return assigned, cipher


def garbled_documents(docs: DataFrame, rounds: int = 3) -> tuple[DataFrame, PairModel, Cipher]:
    """((doc_id, source, swap, log_odds) of garbled documents, the last pair model, the learned mappings).

    docs: (doc_id, source, text). Texts that are NULL, empty or plain ASCII are never garbled; a text with
    U+FFFD always is. The driver holds counts of (unit, left, right): units are single characters or the
    runs of the swap table, neighbours are ASCII characters and two classes, so their number is bounded
    by the alphabet, not by the documents. Documents are only read in Arrow batches, whole.
    """
    rows = cut(_unit_rows(docs), "units")
    priors: dict[str, dict[str, float]] = {}
    assigned = rows.withColumn("swap", F.lit(""))
    for turn in range(rounds):
        pairs = assigned.select("swap", F.explode(F.arrays_zip("places", "n")).alias("p"))
        counts: Counter[tuple[str, str, str]] = Counter()
        seen = pairs.groupBy("swap", "p.places").agg(F.sum("p.n").alias("n"))
        places = set()
        for swap, place, n in seen.toLocalIterator():
            u, left, right = place.split("\t")
            places.add((u, left, right))
            # At first a run is taken for garbled (its letters get no count); later it is read by its document's swap.
            if turn == 0 and len(u) > 1:
                continue
            c = swaps().get(swap, {}).get(u, u)
            counts[c, left, right] += n
        model = PairModel(counts)
        gains = model.gains(sorted(places))
        assigned = cut(_assigned(rows, gains, priors), "swaps")
        if turn < rounds - 1:
            totals: Counter[str] = Counter()
            hits: dict[str, Counter[str]] = {}
            for source, swap, n in assigned.groupBy("source", "swap").agg(F.count("*").alias("n")).toLocalIterator():
                totals[source or ""] += n
                hits.setdefault(source or "", Counter())[swap] += n
            priors = {s: {k: float(np.log((h[k] + 0.1) / (totals[s] + 100.0))) for k in swaps()} for s, h in hits.items()}
    assigned, cipher = _learned(assigned, counts)
    return assigned.filter("swap != ''").select("doc_id", "source", "swap", "log_odds"), model, cipher


def restored_documents(docs: DataFrame, garbled: DataFrame, model: PairModel, cipher: Cipher) -> DataFrame:
    """(doc_id, swap, restored): the text with its swap undone; NULL where characters were lost.

    Single characters whose own reading is the likelier one in their place are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, cipher))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, learned = shared.value
        for batch in batches:
            out: list[str | None] = []
            for text, swap, source in zip(batch["text"], batch["swap"], batch["source"]):
                if swap == "lost" or LOST in text:
                    out.append(None)
                    continue
                if swap == "learned":
                    out.append(restored(text, learned.mapping(source or ""), frozenset()))
                    continue
                mapping = swaps()[swap]
                counts = unit_counts(text)
                gain: Counter[str] = Counter()
                for (u, left, right), n in counts.items():
                    if len(u) == 1 and u in mapping:
                        gain[u] += n * (pairs.score(mapping[u], left, right) - pairs.score(u, left, right))
                out.append(restored(text, mapping, frozenset(u for u, g in gain.items() if g <= 0)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "swap": batch["swap"], "restored": out})

    joined = docs.select("doc_id", "text").join(garbled.select("doc_id", "source", "swap"), "doc_id")
    return joined.select("doc_id", "text", "source", "swap").mapInPandas(run, "doc_id long, swap string, restored string")
