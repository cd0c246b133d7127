import random

import numpy as np
import pytest

from cellweft.llm import language as L

P = L.LanguageParams()


def longest(text, train, i):
    """Length of the longest suffix of text[:i+1] that some training text contains."""
    n = 0
    while n <= i and any(text[i - n:i + 1] in t for t in train):
        n += 1
    return n


def test_match_lengths_equal_brute_force(monkeypatch):
    rng = random.Random(1)
    make = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    samples = {"x": [make(60, "abc "), make(40, "abd ")], "y": [make(80, "bcde ")]}
    lang = L.Languages({k: list(v) for k, v in samples.items()})
    monkeypatch.setattr(L, "CHUNK", 37)
    monkeypatch.setattr(L, "LEAD", 5)
    for n in (1, 5, 36, 37, 38, 150, 260):
        # The longest one quotes the samples, so matches run over chunks.
        t = make(n, "abcdez ") if n < 260 else make(30, "abcdez ") + samples["x"][0] + samples["y"][0] + samples["x"][1] + make(50, "ab")
        n = len(t)
        m = lang.matches([lang.coded(t)])[0]
        for k, name in enumerate(lang.names):
            for i in range(n):
                assert m[k, i] == longest(t, samples[name], i), (name, i, t)


def test_parts_and_groups_do_not_show(monkeypatch):
    rng = random.Random(2)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(1, 9)))
    samples = {k: [" ".join(word(a) for _ in range(60)) for _ in range(4)] for k, a in (("x", "abcde"), ("y", "cdefg"))}
    lang = L.Languages({k: list(v) for k, v in samples.items()})
    texts = ["", "abc", *(" ".join(word("abcdefg7") for _ in range(n)) + samples["x"][1][:90] for n in (3, 300, 40, 1000))]
    whole = lang.phrases(texts)
    found = L.passages([w[1:] for w in whole], P)
    monkeypatch.setattr(L, "PART", 130)
    monkeypatch.setattr(L, "CELLS", 500)
    parts = lang.phrases(texts)
    for (s, c, n), (s2, c2, n2) in zip(whole, parts):
        assert s == s2 and np.allclose(c, c2) and (n == n2).all()
    assert [[x[:3] for x in f] for f in L.passages([w[1:] for w in parts], P)] == [[x[:3] for x in f] for f in found]


def test_a_long_text_beside_short_ones_takes_little_memory():
    import tracemalloc

    parsed = [(np.ones((40_000, 7)), np.ones(40_000))] + [(np.ones((3, 7)), np.ones(3))] * 511
    tracemalloc.start()
    L.passages(parsed, P)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20


@pytest.fixture(scope="module")
def tables(spark, sf):
    return spark.read.parquet(f"{sf('0.01')}/documents.parquet"), spark.read.parquet(f"{sf('0.01')}/lang_codes.parquet")


def test_held_out_accuracy(spark, tables):
    """Long sentences whose commonest words leave no doubt, against the passages they lie in."""
    docs, codes = tables
    common = {
        "en": "the of and but most which".split(), "de": "der die das und dem nicht eine".split(), "fr": "le les des du dans une est".split(),
        "es": "el los las del una con según".split(), "it": "il della di che nella una".split(), "nl": "het een van de niet bij".split(), "pt": "o do da uma com os".split()}
    found = {}
    for r in L.document_passages(docs, codes).collect():
        found.setdefault(r["doc_id"], []).append(r)
    right = wrong = 0
    for r in docs.where("text IS NOT NULL").select("doc_id", "text").collect():
        ws = [L.plain(r["text"])[a:b] for a, b in L.words(L.plain(r["text"]))]
        for p in found.get(r["doc_id"], []):
            part = ws[p["first_word"]:p["first_word"] + p["n_words"]]
            score = sorted(((sum(w in s for w in part), k) for k, s in common.items()), reverse=True)
            if score[0][0] >= 3 and score[0][0] >= 2 * score[1][0]:
                right, wrong = right + (score[0][1] == p["lang_code"]), wrong + (score[0][1] != p["lang_code"])
    assert right > 500 and right / (right + wrong) >= 0.98


def test_labels_and_mixture(spark, tables):
    docs, codes = tables
    en = "The second section contains the expected neighbourhood entropy, because the tissue had folded during mounting."
    de = "Der zweite Schnitt zeigt die erwartete Entropie der Nachbarschaft, obwohl die Zählwerte niedrig und ungleich waren."
    rows = [
        (-1, en, " EN ", "x"), (-2, en, "de", "x"), (-3, en, None, "x"), (-4, de + " " + en, "de", "x"), (-5, de.upper(), "german", "x"),
        (-6, None, "en", "x"), (-7, "", "en", "x"), (-8, "one two three", "de", "x"), (-9, "12 34 56 78 90 12 34 56 78 90", "de", "x"), (-10, (en + "\n") * 400, "fr", "x"),
    ]
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_code string")
    both = docs.select("doc_id", "text", "lang").unionByName(extra.drop("lang_code"))
    found = L.document_passages(both, codes)
    got = {(r["doc_id"], r["lang_code"]) for r in L.wrong_labels(both, found, codes).collect() if r["doc_id"] < 0}
    assert got == {(-2, "en"), (-3, "en"), (-4, "de"), (-4, "en"), (-10, "en")}


def test_no_labels_no_languages(spark, tables):
    _, codes = tables
    docs = spark.createDataFrame([(1, "some text of more than eight words is in this row here", None)], "doc_id long, text string, lang string")
    assert L.document_passages(docs, codes).collect() == []
    assert L.document_passages(docs.where("doc_id = 2"), codes).collect() == []


def test_passages_follow_costs():
    cost = np.array([[0.1, 1.0]] * 10 + [[1.0, 0.1]] * 9)
    got = L.passages([(cost, np.full(19, 5.0)), (np.zeros((0, 2)), np.zeros(0))], P)
    assert [(a, e, k) for a, e, k, _ in got[0]] == [(0, 10, 0), (10, 19, 1)] and got[1] == []
    dear = np.full((6, 2), 4.0)
    assert [x[2] for x in L.passages([(dear, np.full(6, 5.0))], P)[0]] == [-1]
