"""Rules of the detector on fresh items, features, versions and odd inputs."""

import pytest

from stemwright.operators import detector

OPTIONS = ["Aspirin", "Bisoprolol", "Codeine", "Digoxin", "Enalapril"]


def item(stem="A nurse aged 40 has a cough. Which drug is best?", options=None, answer="A"):
    return stem, list(options or OPTIONS), answer


CASES = [
    ("except at the end", item("All of these relieve a cough except:"), "negative_stem", 1),
    ("capital NOT", item("Which drug is NOT helpful?"), "negative_stem", 1),
    ("lower-case not as predicate", item("Which finding is not associated with gout?"), "negative_stem", 1),
    ("not in the vignette", item("She does not smoke. Which drug is best?"), "negative_stem", 0),
    ("at least", item("Which dose lasts at least 8 hours?"), "negative_stem", 0),
    ("least likely", item("Which cause is least likely?"), "negative_stem", 1),
    ("blank", item("The drug of choice is ____."), "fill_in_blank", 1),
    ("bracket blank", item("The drug is [blank]."), "fill_in_blank", 1),
    ("no blank", item(), "fill_in_blank", 0),
    ("true statement", item("Which of the following statements is true?"), "true_false_stem", 1),
    ("yes and no options", item(options=["Yes", "No", "true", "FALSE", "yes"]), "true_false_stem", 1),
    ("all of the above", item(options=[*OPTIONS[:4], "All of the above"]), "all_of_the_above", 1),
    ("none of these", item(options=[*OPTIONS[:4], "None of these"]), "none_of_the_above", 1),
    ("neither", item(options=[*OPTIONS[:4], "Neither of the above"]), "none_of_the_above", 1),
    ("both A and C", item(options=[*OPTIONS[:4], "Both A and C"]), "combination_options", 1),
    ("II and III", item(options=[*OPTIONS[:4], "II and III"]), "combination_options", 1),
    ("1, 2 and 3 only", item(options=[*OPTIONS[:4], "1, 2 and 3 only"]), "combination_options", 1),
    ("lone numeral", item(options=[*OPTIONS[:4], "IV"]), "combination_options", 0),
    ("two drugs", item(options=[*OPTIONS[:4], "Aspirin and codeine"]), "combination_options", 0),
    ("longest key", item(options=["A much longer option with many words", *OPTIONS[1:]]), "longest_option_key", 1),
    ("long but three words", item(options=["Acetylsalicylic acid intravenously", *OPTIONS[1:]]), "longest_option_key", 0),
    ("longest distractor", item(options=["A much longer option with many words", *OPTIONS[1:]], answer="B"), "longest_option_key", 0),
    ("always", item(options=[*OPTIONS[:4], "Surgery is always needed"]), "absolute_terms", 1),
    ("every day", item(options=[*OPTIONS[:4], "Tablets every other day"]), "absolute_terms", 0),
    ("all-cause with a dash", item(options=[*OPTIONS[:4], "Lower all‑cause mortality"]), "absolute_terms", 0),
    ("all of a kind", item(options=[*OPTIONS[:4], "Stop all drugs because of bleeding"]), "absolute_terms", 1),
    ("usually", item(options=[*OPTIONS[:4], "Usually harmless"]), "vague_terms", 1),
    ("unusual", item(options=[*OPTIONS[:4], "Unusual and harmless"]), "vague_terms", 0),
    ("repeated word", item("A man has amyloid deposits. What is found?", ["Amyloid protein", *OPTIONS[1:]]), "clang_cue", 1),
    ("repeated in all", item("A man has amyloid deposits. What is found?", ["Amyloid protein", "Amyloid plaque", *OPTIONS[2:]]), "clang_cue", 0),
    ("crackles and crackle", item("She has crackles. What is heard?", ["Fine crackle", *OPTIONS[1:]]), "clang_cue", 1),
    ("article an", item("The drug is an", ["Antacid", "Beta blocker", "Emetic", "Opioid", "Antibiotic"]), "grammatical_cue", 1),
    ("article fits", item("The drug is an", ["Antacid", "Emetic", "Opioid", "Antibiotic", "Inhibitor"]), "grammatical_cue", 0),
    ("key alone a sentence", item(options=["Give the drug at once.", "Stop it", "Wait", "Test", "Refer"]), "grammatical_cue", 1),
    ("numbers and words", item(options=["5 mg", "10 mg", "Codeine", "Digoxin", "Enalapril"]), "nonparallel_options", 1),
    ("sentence and fragments", item(options=["Give the drug at once.", "Stop it", "Wait", "Test", "Refer"]), "nonparallel_options", 1),
    ("uneven", item(options=["One", "Two", "Three", "Four", "this is a very long option of many words indeed here"]), "nonparallel_options", 1),
    ("out of order", item(options=["5 mg", "20 mg", "10 mg", "40 mg", "30 mg"]), "numeric_not_ordered", 1),
    ("falling", item(options=["50 mg", "40 mg", "30 mg", "20 mg", "10 mg"]), "numeric_not_ordered", 0),
    ("thousands", item(options=["900", "1,000", "1,100", "1,200", "1,300"]), "numeric_not_ordered", 0),
    ("inside another", item(options=["Elevated troponin.", "Elevated troponin and pain", *OPTIONS[2:]]), "overlapping_options", 1),
    ("inside a word", item(options=["complete", "incomplete", *OPTIONS[2:]]), "overlapping_options", 0),
    ("inside a number", item(options=["800 mL", "4800 mL", *OPTIONS[2:]]), "overlapping_options", 0),
    ("pattern characters", item(options=["ratio (a+b", "the ratio (a+b of two", *OPTIONS[2:]]), "overlapping_options", 1),
    ("outlier", item(options=["aaaa", "bbbb", "cccc", "dddd", "e" * 30]), "option_length_outlier", 1),
    ("units", item(options=["1 mg", "2 mg", "3 g", "4 g", "5 g"]), "numeric_units_inconsistent", 1),
    ("alphabet", item(options=["b", "a", "c", "d", "e"]), "options_not_alphabetical", 1),
    ("in order", item(), "options_not_alphabetical", 0),
    ("key in brackets", item(options=["A much longer option with many words", *OPTIONS[1:]], answer=" (a) "), "longest_option_key", 1),
    ("unreadable key", item(options=["A much longer option with many words", *OPTIONS[1:]], answer="A or B"), "longest_option_key", 0),
]


@pytest.fixture(scope="module")
def flagged(spark):
    rows = [(i, s, [("ABCDEFGHIJ"[k], t) for k, t in enumerate(o)], a) for i, (_, (s, o, a), _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, stem string, options array<struct<l:string,t:string>>, answer string")
    return {r["id"]: r for r in detector.detect(df, keep=["id"]).collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[c[0] for c in CASES])
def test_rule(flagged, i):
    assert flagged[i][CASES[i][2]] == CASES[i][3]


def test_versions_differ(spark):
    rows = [(0, "Which drug?", [("A", "IV"), ("B", "Codeine"), ("C", "800 mL"), ("D", "4800 mL"), ("E", "Digoxin")], "A")]
    df = spark.createDataFrame(rows, "id int, stem string, options array<struct<l:string,t:string>>, answer string")
    hits = {v: detector.detect(df, v, keep=["id"]).first() for v in ("1.0", "1.1", "1.2")}
    assert [hits[v]["combination_options"] for v in hits] == [1, 1, 0]
    assert [hits[v]["overlapping_options"] for v in hits] == [1, 0, 0]


def test_odd_inputs(spark):
    long = "word " * 20_000
    rows = [
        (0, None, None, None), (1, "", [], ""), (2, long, [("A", long), ("B", "x"), ("C", None)], "A"),
        (3, "Which statement is true?", [], "A"), (4, "x", [("A", "first"), ("a", "second"), ("B", "b"), ("C", "c")], "A"),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "id int, stem string, options array<struct<l:string,t:string>>, answer string, key int")
    out = {r["id"]: r for r in detector.detect(df, keep=["id"]).collect()}
    assert out[0]["n_flaws"] == 0 and out[3]["true_false_stem"] == 0
    assert out[4]["n_options"] == 3 and out[4]["key_chars"] == len("second")
    assert out[2]["stem_words"] == 20_000
    assert detector.detect(df.filter("false"), keep=["id"]).count() == 0
