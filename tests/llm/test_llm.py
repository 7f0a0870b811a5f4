"""Operators for training data: edge cases on small fixtures, brute force, and the queries against their SQL."""

import difflib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("stemwright.llm")
from stemwright.llm import consensus, entity_map, fusion, golay, leaks, mixing, mojibake, near_duplicates, queries, sampling, truncation  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(name, spark, sf_dir):
    df = queries.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


# ---- problem 1
ENTRIES = [("q1", "yes", 11), ("q1", "no", 12), ("q1", "unsure", 13), ("q1", "not applicable", 14), ("q5", "yes", 51), ("q5", "minor edits", 52),
           ("q5", "major edits", 53), ("q5", "no", 54), ("q5", "cannot judge", 55)]


def test_map_cells(spark):
    cases = [
        ("q1", "Q1: yep - changed later", 11), ("q1", "yes or no", 0), ("q1", "n/a", 14), ("q1", "(2nd look) noo", 12), ("q1", None, 0), ("q1", "", 0),
        ("q1", "minor edits", 0), ("q5", "minro eits", 52), ("q5", "maj. ed.", 53), ("q5", "no; yes would be wrong", 54), ("q5", "x" * 50_000, 0),
        ("q5", "cannot judge/yes", 0), ("q5", "yes yes", 51), ("q5", "12 min", 0), ("q5", "eys", 51), ("q5", "eys", 51),
    ]
    cells = spark.createDataFrame([(g, r, w, "kept") for g, r, w in cases], "grp string, raw string, wanted int, entry_id string")
    out = entity_map.map_cells(cells, spark.createDataFrame(ENTRIES, "grp string, entry string, entry_id int"))
    rows = out.collect()
    assert len(rows) == len(cases)
    assert [(r.raw, r.wanted, r.entry_id) for r in rows if r.wanted != r.entry_id] == []


def test_map_cells_empty(spark):
    cells = spark.createDataFrame([], "grp string, raw string")
    assert entity_map.map_cells(cells, spark.createDataFrame(ENTRIES, "grp string, entry string, entry_id int")).count() == 0


def test_join_is_exact(spark):
    """The prefix, length and positional filters lose no match that comparing all pairs finds."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(120)})
    refs = words[::6]
    values = spark.createDataFrame([("g", w) for w in words], "grp string, value string")
    references = spark.createDataFrame([("g", r, i) for i, r in enumerate(refs)], "grp string, name string, entry_id int")

    def toks(s):
        flat = sorted([*s, *(("^" + s + "$")[i : i + 2] for i in range(len(s) + 1))])
        return {(t, flat[:i].count(t)) for i, t in enumerate(flat)}

    wanted = {}
    for w in words:
        scores = sorted(((len(toks(w) & toks(r)) / len(toks(w) | toks(r)), i) for i, r in enumerate(refs)), reverse=True)
        if scores[0][0] >= 0.4 - 1e-9 and scores[0][0] - scores[1][0] > 1e-9:
            wanted[w] = scores[0][1]
    found = {r.value: r.entry_id for r in entity_map.best_matches(values, references, 0.4).collect()}
    assert found == wanted


# ---- problem 3
def test_preferred_rows(spark):
    rows = [
        ("a", 1, None, True), ("a", 2, " ", True), ("a", 3, "x", False), ("b", 4, "y", True), (None, 5, "z", True), (None, 6, "z", True),
        ("c", 7, None, True), ("c", 8, None, False), ("d", 9, "p", True), ("d", 9, "p", True),
    ]
    df = spark.createDataFrame([(*r, "n") for r in rows], "k string, id long, v string, good boolean, n string")
    out = fusion.preferred_rows(df, "k", "id", ["v"], [(~F.col("good")).cast("int")])
    assert sorted(map(tuple, out.collect())) == [("a", "v", 3), ("d", "v", 9)]
    assert fusion.preferred_rows(df.filter("false"), "k", "id", ["v"], [F.lit(0)]).count() == 0


def test_truth_discovery(spark):
    """Two sources that are usually right outvote three that copy a wrong value."""
    claims = []
    for i in range(40):
        for s in ("good1", "good2", "good3"):
            claims.append((f"e{i}", "f", f"t{i}", s))
        for s in ("bad1", "bad2"):
            claims.append((f"e{i}", "f", f"w{s}{i}", s))
    for i in range(40, 44):
        claims += [(f"e{i}", "f", f"t{i}", "good1"), (f"e{i}", "f", f"t{i}", "good2"), (f"e{i}", "f", f"w{i}", "bad1"), (f"e{i}", "f", f"w{i}", "bad2")]
    claims += [("n", "f", None, "good1")]
    df = spark.createDataFrame(claims, "entity string, field_name string, value string, source string")
    truths, sources = fusion.truth_discovery(df)
    assert {r.entity: r.value for r in truths.collect()} == {f"e{i}": f"t{i}" for i in range(44)}
    weight = {r.source: r.reliability for r in sources.collect()}
    assert min(weight["good1"], weight["good2"]) > max(weight["bad1"], weight["bad2"])
    assert fusion.truth_discovery(df.filter("false"))[0].count() == 0


# ---- problem 4
def _kept(spark, n, parts):
    keys = spark.createDataFrame([(f"j{i}", i, "m" if i % 3 else None) for i in range(n)], "job string, pos long, label string").repartition(parts)
    return {r.job for r in sampling.golden_sample(keys, ["label"], "pos", 0.25).collect()}


def test_sample_is_stable(spark):
    few, many = _kept(spark, 300, 1), _kept(spark, 900, 7)
    assert few == {j for j in many if int(j[1:]) < 300}
    assert few == _kept(spark, 300, 5)
    assert abs(len(many) - 225) <= 4
    assert _kept(spark, 0, 1) == set() if spark.createDataFrame([], "a int").count() else True


# ---- problem 5
def test_golay_code(spark):
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300)
    flips = [(1 << int(a)) | (1 << int(b)) for a, b in rng.integers(0, 23, (300, 2))]
    df = spark.createDataFrame([(int(w), int(w) ^ int(f)) for w, f in zip(words, flips)], "a int, b int")
    at = lambda c: F.array_compact(F.array(*[golay.near_index(F.col(c), F.lit(i)) for i in range(6)]))
    rows = df.select(at("a").alias("x"), at("b").alias("y")).collect()
    assert all(len(r.x) in (1, 6) and set(r.x) & set(r.y) for r in rows)


def _stems(spark, texts):
    return spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "row_id long, text string, jaccard string")


def _similar(df, **at):
    return near_duplicates.similar_texts(*near_duplicates.text_classes(df, [], 3), df, **at)


def test_words_are_those_of_the_expression(spark):
    texts = ["", " ", "One", "été 12-b", "a" * 5000, "x y  z\n1 É", "\u2603", "ends here.", None, "A a A"]
    words, lengths = near_duplicates.word_hashes(texts)
    rows = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "i int, t string").select("i", near_duplicates.normalised(F.col("t")).alias("n")).orderBy("i").collect()
    split = [r.n.split() for r in rows]
    assert lengths.tolist() == [len(ws) for ws in split]
    flat = [w for ws in split for w in ws]
    known: dict = {}
    assert all(known.setdefault(w, h) == h for w, h in zip(flat, words.tolist())) and len(set(known.values())) == len(known)
    hashes = near_duplicates.text_hashes(words, lengths).tolist()
    assert len(set(hashes)) == len({tuple(ws) for ws in split})


def test_golay_indices_agree(spark):
    words = np.random.default_rng(3).integers(0, 1 << 23, 200)
    at, index = golay.near_indices(words)
    rows = spark.createDataFrame([(i, int(w)) for i, w in enumerate(words)], "i int, w int").select("i", F.array_compact(F.array(*[golay.near_index(F.col("w"), F.lit(k)) for k in range(6)])).alias("x")).collect()
    assert all(sorted(index[at == r.i].tolist()) == sorted(r.x) for r in rows)


def test_recall_at_every_length(spark):
    """Blocks and single words changed to a similarity between 0.5 and 0.6, from 30 to 300 words."""
    rng, texts = random.Random(8), []
    for i in range(400):
        n = 30 + 270 * i // 400
        base = [f"t{i}w{k}" for k in range(n)]
        copy = list(base)
        if i % 2:
            size = int((n - 2) * 0.29) - 2
            at = rng.randrange(n - size)
            copy[at : at + size] = [f"x{i}w{k}" for k in range(size)]
        else:
            for k in range(2, n - 1, 9):
                copy[k] = f"x{i}w{k}"
        texts += [" ".join(base), " ".join(copy)]
    rows = _similar(_stems(spark, texts)).collect()
    sets = [{tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for t in texts]
    wanted = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    hits = [w for w in wanted if w >= 0.5]
    assert len(hits) > 200 and np.mean(hits) < 0.6
    assert len(hits) >= len(rows) >= 0.95 * len(hits)


def test_blocks_of_pairs():
    key = np.array([1, 1, 1, 2, 3, 3, 9])
    for most in (1, 2, 100):
        got = sorted((int(a), int(b)) for i, j in near_duplicates._equal_pairs(key, most) for a, b in zip(i, j))
        assert got == [(0, 1), (0, 2), (1, 2), (4, 5)]


def test_copies_hold_a_third(spark):
    """A text copied many times and its variants still meet, though its shingles are in most texts."""
    rng = random.Random(9)
    base = [f"c{k}" for k in range(60)]
    texts = [" ".join(base)] * 200
    for i in range(12):
        copy = list(base)
        copy[5 * i] = f"v{i}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"o{rng.randrange(10**6)}" for _ in range(60)) for _ in range(300)]
    assert _similar(_stems(spark, texts)).count() == 13 * 12 // 2


def test_similar_texts_against_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(90)]
        texts.append(" ".join(base))
        for edits in (1, 3, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [texts[0]] * 50 + [None, "", "two words", "w1 w2 w3"]
    df = _stems(spark, texts)
    found = {(r.h_a, r.h_b) for r in _similar(df).collect()}
    rows = near_duplicates.text_classes(df, ["jaccard"], 3)[0].collect()
    assert len(rows) == len(texts) - 3
    shingles = {r.h: {tuple(texts[r.row_id].split()[i : i + 3]) for i in range(len(texts[r.row_id].split()) - 2)} for r in rows}
    ids = sorted(shingles)
    wanted = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 2 * len(shingles[a] & shingles[b]) >= len(shingles[a] | shingles[b])}
    assert not found - wanted
    assert len(found) >= 0.9 * len(wanted) > 100


@pytest.mark.parametrize("n_words, added", [(105, 50), (120, 60), (150, 75), (300, 70), (900, 800)])
def test_similar_long_texts(spark, n_words, added):
    """Pairs that differ in many words are found at every length: their flips grow with it, their similarity doesn't."""
    texts = []
    for i in range(200):
        base = [f"t{i}w{k}" for k in range(n_words + added)]
        texts += [" ".join(base[:n_words]), " ".join(base)]
    pairs = _similar(_stems(spark, texts)).collect()
    assert all(r.jaccard >= 0.5 for r in pairs)
    assert 190 <= len(pairs) <= 200


def test_flips_of_repeated_words(spark):
    """A text given twice in a row has nearly the same shingles, while every one of its words changes its bit."""
    base = " ".join(f"w{k}" for k in range(300))
    assert _similar(_stems(spark, [base, f"{base} {base}"])).count() == 1


def test_similar_texts_empty(spark):
    assert _similar(_stems(spark, [None, "", "two words"])).count() == 0


def _all_pairs(texts):
    sets = [{tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for t in texts]
    return {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 2 * len(a & b) >= len(a | b) > 0}


def _variants(rng, count, words, changed):
    base, texts = [f"c{k}" for k in range(words)], []
    for i in range(count):
        copy = list(base)
        for k in rng.sample(range(words), changed):
            copy[k] = f"v{i}w{k}"
        texts.append(" ".join(copy))
    return texts


def test_many_near_copies_of_one_text_all_meet(spark):
    """Hundreds of different near-copies share frequent shingles only; no pair of them is lost."""
    texts = _variants(random.Random(11), 300, 60, 3)
    wanted = _all_pairs(texts)
    assert len(wanted) > 10_000
    assert _similar(_stems(spark, texts)).count() == len(wanted)


def test_long_lists_are_split_without_loss(tmp_path, monkeypatch):
    rng = random.Random(12)
    texts = _variants(rng, 60, 40, 2) + _variants(rng, 60, 9, 1) + ["c1 c2 c3", "c1 c2 c3 c4", "c2 c3 c4 c5", "c1 c2 c3 c4 c5", "x y z", "x y z z"]
    words, lengths = near_duplicates.word_hashes(texts)
    token, sizes, bits = near_duplicates.ordered_sets(words, lengths, near_duplicates.ranks(np.ones(1025, dtype=np.int64)), 3)
    ends = np.cumsum(sizes)
    sets = [token[e - k : e].tobytes() for e, k in zip(ends, sizes)]
    path = f"{tmp_path}/sets.parquet"
    pq.write_table(pa.table({"h": np.arange(len(texts)), "s": pa.array(sets, pa.binary()), "k": pa.array([b.tobytes() for b in bits], pa.binary())}), path)
    for few, many in ((24, 4096), (2, 8), (1, 3)):
        monkeypatch.setattr(near_duplicates, "FEW", few)
        monkeypatch.setattr(near_duplicates, "MANY", many)
        found = set()
        for part in range(3):
            for batch in near_duplicates.Lists([f"file://{path}"], part, 3, 0.5).pairs():
                found |= set(zip(batch.column("h_b").to_pylist(), batch.column("h_a").to_pylist()))
        assert found == _all_pairs(texts)


def _lists_of(texts, counts, path, n=3):
    """All texts' sets, in the order that the counts give their shingles, as one part."""
    token, sizes, bits = near_duplicates.ordered_sets(*near_duplicates.word_hashes(texts), near_duplicates.ranks(counts), n)
    sets = [token[e - k : e].tobytes() for e, k in zip(np.cumsum(sizes), sizes)]
    pq.write_table(pa.table({"h": np.arange(len(texts)), "s": pa.array(sets, pa.binary()), "k": pa.array([b.tobytes() for b in bits], pa.binary())}), path)
    return near_duplicates.Lists([f"file://{path}"], 0, 1, 0.5)


def test_what_stands_before_the_first_common_shingle_counts(tmp_path):
    """Texts whose first common shingle stands late have little left to differ by: none of their pairs is left to be compared shingle by shingle."""
    count, counts = 100, np.ones((1 << 18) + 1, dtype=np.int64)
    middle = [f"s{k}" for k in range(27)]
    texts = [" ".join([*(f"e{i}w{k}" for k in range(16)), *middle, *(f"l{i}w{k}" for k in range(9))]) for i in range(count)]
    for part, often in ((middle, 1 << 10), *(((t.split()[41:]), 1 << 12) for t in texts)):
        code, _ = near_duplicates.shingle_hashes(*near_duplicates.word_hashes([" ".join(part)]), 3)
        counts[near_duplicates._slots(near_duplicates._tokens(code), len(counts) - 1)] = often
    lists = _lists_of(texts, counts, f"{tmp_path}/sets.parquet")
    assert sum(len(x) for x, _ in lists.meet(*lists.postings)) < 100  # of 4,950 pairs, which have 16 shingles each before the first common one
    assert not _all_pairs(texts)


@pytest.mark.parametrize("width", [64, 128, 256, 512])
def test_sketches_of_any_width_lose_no_pair(tmp_path, monkeypatch, width):
    rng = random.Random(width)
    texts = [t for words, changed in ((60, 4), (60, 6), (25, 2), (300, 21)) for t in _variants(rng, 60, words, changed)]
    texts += [t + " " + " ".join(f"x{i}w{k}" for k in range(rng.randrange(40))) for i, t in enumerate(texts)]
    monkeypatch.setattr(near_duplicates, "FEW", 2)
    monkeypatch.setattr(near_duplicates, "STEP", 32)
    monkeypatch.setattr(near_duplicates, "TILE", 48)
    monkeypatch.setattr(near_duplicates, "BEFORE", 300)
    monkeypatch.setattr(near_duplicates.Lists, "_width", staticmethod(lambda rest, free: width))
    wanted = _all_pairs(texts)
    assert 1_000 < len(wanted) < len(texts) * (len(texts) - 1) // 3
    for many in (4096, 100):  # whole lists, split lists and lists of several blocks
        monkeypatch.setattr(near_duplicates, "MANY", many)
        lists = _lists_of(texts, np.ones(1025, dtype=np.int64), f"{tmp_path}/sets.parquet")
        found = {p for b in lists.pairs() for p in zip(b.column("h_b").to_pylist(), b.column("h_a").to_pylist())}
        assert found == wanted


def _shuffled_rows(spark):
    """Rows written to shuffles so far."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_of_copies_are_not_shuffled(spark, tmp_path):
    """Jobs with the same stem give pairs by the square of their number; the rows shuffled grow with the jobs only."""
    jobs, others = 400, 12
    stem = " ".join(f"s{k}" for k in range(40))
    rows = [(i, f"job{i:04d}", stem) for i in range(jobs)]
    rows += [(jobs + i, f" JOB{i:04d}", f"{stem} and {i} more") for i in range(others)]  # other stems of the first jobs
    spark.createDataFrame(rows, "ord long, job_id string, stem string").write.parquet(f"{tmp_path}/items_full.parquet")
    before = _shuffled_rows(spark)
    found = [(r.job_a, r.job_b) for r in queries.p5_found(spark, str(tmp_path)).collect()]
    assert len(found) == len(set(found)) == jobs * (jobs - 1) // 2
    assert _shuffled_rows(spark) - before < 40_000


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (12, 12)], "h_a long, h_b long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 10, 11, 12, 20)], "h long")
    out = {r.h: r.component for r in near_duplicates.connected_components(nodes, edges).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 12: 12, 20: 20}


# ---- problem 6
def test_truncated(spark):
    rng = random.Random(2)
    nouns, places = ["fever", "cough", "nausea", "fatigue", "anemia of pregnancy"], ["left knee", "right shoulder", "lower abdomen"]

    def sentence():
        return f"The patient has {rng.choice(nouns)} with pain over the {rng.choice(places)} and a pulse of {rng.randint(50, 120)} per minute."

    rows = [(i, "t", " ".join(sentence() for _ in range(rng.randint(1, 3))), "p") for i in range(400)]
    cut_rows = [(1000 + i, "t", sentence()[: 40 + i % 20], "p") for i in range(20)]
    edge = [(2000, "t", None, "p"), (2001, "t", "", None), (2002, "t", "The patient has fever with pain over the left knee and a pulse of 88 per minute", "p"),
            (2003, "t", "The patient has fever with pain over the le…", None), (2004, "t", " \n ", "p"), (2005, "t", sentence() * 3000, "p")]
    df = spark.createDataFrame(rows + cut_rows + edge, "row_id long, field_name string, text string, provider string").withColumn("n_chars", F.length("text"))
    found = {r.row_id for r in truncation.truncated(df.withColumn("significant", F.lit("x")), ["provider", "field_name"]).collect()}
    assert {1000 + i for i in range(20)} <= found and 2003 in found
    assert not found & {2000, 2001, 2002, 2004, 2005} and not [i for i in found if i < 1000]
    assert truncation.truncated(df.filter("false"), ["provider", "field_name"]).count() == 0


def test_rare_last_word_is_known_from_all_texts(spark):
    """A last word outside the sample of the model, but in a finished text of the corpus, doesn't make a case."""
    rows = [(i, "t", f"The patient was treated and recovered after a course of drug{'abcdefghij'[i % 10]}{'xyz' [i % 3]}.", "p") for i in range(4000)]
    rare = [(5000 + i, "t", f"The patient was treated and recovered after a course of rare{chr(97 + i % 26)}{chr(97 + i // 26)}.", "p") for i in range(300)]
    bare = [(6000 + i, "t", t[:-1], "p") for i, (_, _, t, _) in enumerate(rare)]
    inside = [(7000, "t", "The patient was treated and recovered after a course of drugax and zzunheardof", "p")]
    df = spark.createDataFrame(rows + rare + bare + inside, "row_id long, field_name string, text string, provider string").withColumn("n_chars", F.length("text"))
    odds = {r.row_id: r.log_odds for r in truncation.truncated(df, ["provider", "field_name"], sample_rows=300, doubt=1e9, more_doubt=1e9).collect()}
    assert not [i for i in range(6000, 6300) if odds[i] <= -5] and odds[7000] <= -5


def test_words_of_finished_texts():
    texts = ['He said: "fever, cough (mild)." It rose 12.5/3 fold.', 'Give insulin."', "Is it so? Yes! 7 days:"]
    assert {"fever", "cough", "mild", "it", "rose", "0", "fold", "insulin", "so", "yes", "days"} <= truncation.text_words(texts)


def test_length_hazards(spark):
    rng = random.Random(1)
    rows = [("p", "t", rng.randint(80, 400)) for _ in range(3000)] + [("p", "t", 256)] * 80
    df = spark.createDataFrame(rows, "provider string, field_name string, n_chars int")
    out = truncation.length_hazards(df, ["provider", "field_name"]).filter("significant").collect()
    assert [r.n_chars for r in out] == [256]


# ---- problem 7
def test_annotators(spark):
    rng = random.Random(4)
    votes, truth = [], {}
    for i in range(150):
        truth[f"i{i}"] = rng.choice("abc")
        for rater, care in (("r1", 0.95), ("r2", 0.9), ("r3", 0.85), ("r4", 0.35)):
            label = truth[f"i{i}"] if rng.random() < care else rng.choice("abc")
            votes.append((f"i{i}", "q", rater, label, 1))
    votes.append((None, "q", "r1", "a", 1))
    df = spark.createDataFrame(votes, "item_id string, question string, rater string, label string, truth int")
    posteriors, reliabilities, converged = consensus.annotator_model(df)
    assert converged
    best = posteriors.groupBy("item_id").agg(F.max_by("truth", "p").alias("t")).collect()
    assert sum(truth[r.item_id] == r.t for r in best) >= 140
    weight = {r.rater: r.reliability for r in reliabilities.collect()}
    assert weight["r1"] > weight["r4"] + 0.2
    assert consensus.consensus_labels(df.filter("false")).count() == 0


def test_model_overrules_careless_majorities(spark):
    """Two raters always say a; where a third slips to a as well, the model takes the label of the careful ones."""
    rng, votes, truth = random.Random(12), [], {}
    for i in range(300):
        truth[f"i{i}"] = rng.choice("abc")
        for rater, care in (("r1", 0.97), ("r2", 0.97), ("r3", 0.8)):
            votes.append((f"i{i}", "q", rater, truth[f"i{i}"] if rng.random() < care else "a"))
        votes += [(f"i{i}", "q", "s1", "a"), (f"i{i}", "q", "s2", "a")]
    rows = consensus.consensus_labels(spark.createDataFrame(votes, "item_id string, question string, rater string, label string")).collect()
    overruled = [r for r in rows if 2 * r.top > r.n_votes and r.label != r.top_label]
    assert len(rows) == 300 and len(overruled) >= 10
    assert sum(r.label == truth[r.item_id] for r in rows) > sum(r.top_label == truth[r.item_id] for r in rows) + 10


# ---- problem 8
def test_leaks_against_all_pairs(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([5, 13, 40])))) for i in range(30)]
    docs = []
    for d in range(120):
        body = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        source = items[rng.randrange(30)][1].split()
        size = rng.randint(10, 20)
        start = rng.randrange(max(1, len(source) - size))
        docs.append((d, " ".join(body[:50] + source[start : start + size] + body[50:])))
    docs += [(500, None), (501, ""), (502, docs[0][1]), (503, items[1][1] if len(items[1][1].split()) >= 13 else docs[1][1])]
    d = spark.createDataFrame([(*x, "e") for x in docs], "id long, text string, minhash string")
    i = spark.createDataFrame(items + [(99, None)], "id long, text string")
    found = {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, i).collect()}
    wanted = set()
    for di, dt in docs:
        for ii, it in items:
            w = it.split()
            if dt and any(f" {' '.join(w[k:k + 13])} " in f" {dt} " for k in range(len(w) - 12)):
                wanted.add((di, ii))
    assert found == wanted and wanted
    assert leaks.leaked_items(d.filter("false"), i).count() == 0


# ---- problem 9
def test_water_fill():
    out = mixing.water_fill({"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, {"a": 100, "b": 1000, "c": 1000}, 1000)
    assert out == {"a": 100.0, "b": pytest.approx(540), "c": pytest.approx(360), "d": 0.0}
    assert sum(mixing.water_fill({"a": 0.5, "b": 0.5}, {"a": 10, "b": 20}, 1000).values()) == pytest.approx(30)
    assert mixing.water_fill({"a": 1.0}, {}, 10) == {"a": 0.0}


def test_mixture(spark):
    rng = random.Random(8)
    rows = [(i, "big", rng.randint(1, 50)) for i in range(2000)] + [(5000 + i, "small", rng.randint(1, 50)) for i in range(100)]
    rows += [(9000, "other", 10), (9001, None, 10), (9002, "big", 0)]
    sizes = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, n_tokens long, copies int")
    targets = spark.createDataFrame([("big", 0.6, 2), ("small", 0.3, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    docs, shares = mixing.mixture(sizes, targets, total=20_000)
    got = {r.source: r for r in shares.collect()}
    assert got["none"].tokens_used == 0
    assert got["small"].tokens_used <= 3 * got["small"].tokens_available
    for s in ("big", "small"):
        assert abs(got[s].tokens_used - got[s].tokens_planned) <= 60
    most = {r.source: r.m for r in docs.groupBy("source").agg(F.max("copies").alias("m")).collect()}
    assert most["big"] <= 2 and most["small"] <= 3
    again, _ = mixing.mixture(sizes.repartition(9), targets, total=20_000)
    assert {tuple(r) for r in docs.collect()} == {tuple(r) for r in again.collect()}
    assert mixing.mixture(sizes.filter("false"), targets)[0].count() == 0


# ---- problem 10
def test_mojibake_round_trip(spark):
    clean = ["Die Prüfung fällt früh und die Übelkeit wäre später größer.", "L’élève a été gêné après l’évaluation où il était déçu.",
             "La opción más común según el niño es señalar la solución.", "The café served naïve visitors at 37.5 °C – “fine”."]
    rows = [(i, "s", t) for i, t in enumerate(clean * 60)]
    swapped = [(1000, clean[0].encode().decode("cp1252", "replace")), (1001, clean[2].encode().decode("latin-1")),
               (1002, clean[0].encode("cp1252").decode("cp850")), (1003, clean[0].encode("cp1252").decode("utf-8", "replace"))]
    edge = [(2000, "s", None), (2001, None, ""), (2002, "s", "plain ASCII"), (2003, "s", "├── folder └── file ✓ São Paulo"), (2004, "s", clean[1] * 500)]
    df = spark.createDataFrame([(*r, "x") for r in rows + [(i, "s", t) for i, t in swapped] + edge], "doc_id long, source string, text string, swap string")
    garbled, model, cipher = mojibake.garbled_documents(df)
    assert {r.doc_id for r in garbled.collect()} == {1000, 1001, 1002, 1003}
    back = {r.doc_id: r.restored for r in mojibake.restored_documents(df, garbled, model, cipher).collect()}
    assert back[1001] == clean[2] and back[1002] == clean[0] and back[1003] is None
    assert mojibake.garbled_documents(df.filter("false"))[0].count() == 0


@pytest.mark.parametrize("written, read", [("cp1252", "cp1253"), ("utf-8", "cp1257"), ("cp1252", None), ("utf-8", None)])
def test_unknown_code_pages_are_learned(spark, written, read):
    """Pages outside the list, one of them in no library, are found by the mapping learned for their source and undone."""
    rng = random.Random(14)
    words = ("médecin déjà vu élève père mère forêt tête bâton âge où après très août clé été jeté früh Müller schön größer Tür für über Gefäß "
             "hören können mögen später Ärzte trägt fällt Nähe être même côté hôpital tôt dîner île").split()
    plain = ("le patient a une fièvre et la toux der Arzt sieht den Fall mit and then pain of chest").split()
    page = [chr(0x10D0 + i) if i < 40 else chr(0x0561 + i - 40) if i < 78 else chr(0x0E01 + i - 78) if i < 124 else chr(0x1210 + i) for i in range(128)]
    rng.shuffle(page)

    def garbled(text):
        data = text.encode(written)
        return mojibake._decode(data, read) if read else "".join(chr(x) if x < 128 else page[x - 128] for x in data)

    rows, hurt, true = [], set(), {}
    for i in range(1200):
        text = " ".join(rng.choice(words if rng.random() < 0.5 else plain) for _ in range(40))
        bad = i % 3 == 1 and i % 10 < 2 and garbled(text) != text
        hurt |= {i} if bad else set()
        true[i] = text
        rows.append((i, f"s{i % 3}", garbled(text) if bad else text))
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found, model, cipher = mojibake.garbled_documents(df)
    ids = {r.doc_id for r in found.collect()}
    assert len(ids & hurt) >= 0.9 * len(hurt) > 50 and len(ids - hurt) <= 0.05 * len(hurt)
    back = {r.doc_id: r.restored for r in mojibake.restored_documents(df, found, model, cipher).collect()}
    right = [difflib.SequenceMatcher(None, back[i], true[i], autojunk=False).ratio() for i in ids & hurt]
    before = [difflib.SequenceMatcher(None, rows[i][2], true[i], autojunk=False).ratio() for i in ids & hurt]
    assert np.mean(right) > 0.97 and np.mean(right) > np.mean(before) + 0.03
