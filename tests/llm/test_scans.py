import math
from collections import Counter

import pytest

from lodestone.llm.scans import MISREAD, Model, is_furniture, learn, repair_scans, running_lines

CLEAN = "The amine-rich support was rinsed until the washings were neutral and the whole structure was immobilized with cellulase."


@pytest.fixture(scope="module")
def model():
    words = {w: 200 for w in CLEAN.lower().replace("-", " ").replace(".", "").split()} | {"two": 50, "step": 50}
    pairs = {p: 100 for p in zip(list(words), list(words)[1:])} | {("washings", "were"): 100}
    return Model(words, pairs, {("amine", "rich"): 40})


@pytest.mark.parametrize("line", ["- 288 -", "464", "[639]", "Page 56 of 71", "p. 17", "xxii", "Pagc 28 0f 70", "622   Loading effects in packed beds", "30 | Drying of preparations", "Loading effects / A00008", "LOADING EFFECTS IN PACKED BEDS", "Notes on Carriers 23 (1995) 579–588", "Manuscript A00008, revision 1", "Reports in Enzymes, Vol. 5, No. 3", "Reports in Enzymes · copy 3"])
def test_furniture(line):
    assert is_furniture(line)


@pytest.mark.parametrize("line", ["24.2 h.", "mL, over 45.1 h. The support", "150 mM salt and more of it", "The support was rinsed", "", "activity (47.91 U). The", "A00008", "pH 4.2 for 39.0 h"])
def test_no_furniture(line):
    assert not is_furniture(line)


def test_repair(model):
    text = "The amine-\nrich support was rin-\n- 12 -\nLoading effects / A00008\nsed until the vvashings were neu‐\ntral and the wh0le sfructure was immobihzed\nwith cell¬\nulase."
    fixed, lines = model.repair(text)
    assert fixed == CLEAN and lines == ["- 12 -", "Loading effects / A00008"]


def test_paragraphs_and_lists_stay(model):
    assert model.repair("The support\nwas rinsed.\n\nThe support")[0] == "The support was rinsed.\n\nThe support"
    assert model.repair("- The support\n- was rinsed")[0] == "- The support\n- was rinsed"
    assert model.repair(CLEAN) == (CLEAN, [])
    assert model.repair("12")[0] == "12"


def test_rows(spark):
    noisy = CLEAN.replace("structure", "sfructure").replace("washings were", "wash-\nings were")
    rows = [(i, CLEAN, 0) for i in range(40)] + [(100, noisy, 0), (100, noisy, 1), (101, None, 0), (102, "", 0), (103, " \n ", 0), (104, "Q" * 30000, 0), (None, "- 3 -", 0)]
    df = spark.createDataFrame(rows, "k int, t string, lines int")
    got = {r.k: r for r in repair_scans(df, ["k"], "t").collect()}
    assert got[100].repaired == CLEAN and got[100].new_words == ["structure", "washings"]
    assert got[101].repaired is None and got[102].repaired == "" and got[103].repaired == "" and got[104].repaired == "Q" * 30000 and got[None].repaired == "- 3 -"
    assert repair_scans(df.limit(0), ["k"], "t").count() == 0


def test_confusions_are_estimated(spark, model):
    """Where t is mostly read as f, that confusion is more likely than one that never happens."""
    into: Counter = Counter()
    model.expected("sfructure", 30, into)
    assert set(into) == {("f", "t")} and 20 < into["f", "t"] <= 30
    prices = model.estimated(into)
    assert prices["f", "t"] > math.log(MISREAD) > prices["l", "t"]
    rows = [(i, CLEAN) for i in range(200)] + [(1000 + i, CLEAN.replace("structure", "sfructure")) for i in range(6)]
    learned = learn(spark.createDataFrame(rows, "k int, t string"), "t").prices
    assert learned["f", "t"] > learned["l", "t"] and set(learned) == set(model.prices)
    assert learn(spark.createDataFrame([], "k int, t string"), "t").prices == Model({}, {}, {}).prices


def test_running_lines_recur_over_pages(spark):
    """A title without any form of its own is taken out where it recurs and interrupts a sentence; a line of text that recurs is not."""
    body = "the support was rinsed until\n{}washings were neutral and clean\nThe whole structure was"
    rows = [(f"k{i}", body.format("The whole structure\n" if i < 4 else ""), "d", i) for i in range(8)] + [(f"e{i}", body.format("The whole structure\n"), "e", 0) for i in range(4)] + [("n", None, None, None), ("m", "a\nb", None, 3)]
    rows += [(f"s{i}", "It was rinsed until washings were neutral.", "s", i) for i in range(6)]
    df = spark.createDataFrame(rows, "k string, t string, doc string, page int")
    assert {r.document: sorted(r.running) for r in running_lines(df, "t", "doc", "page").collect()} == {"d": ["the whole structure", "the whole structure was"]}
    got = {r.k: r.lines for r in repair_scans(df, ["k"], "t", "doc", "page").collect()}
    assert got["k0"] == ["The whole structure"] and got["k7"] == [] and got["e0"] == [] and got["n"] == [] and len(got) == 20
