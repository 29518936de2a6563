import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import candidates
from lodestone.serving import generate, settings


KIND = "group_id int, rank int, source_id string, citation string, record_type string, extracted map<string,string>, metrics array<struct<name string, value double, unit string>>, confidence string, text string"


def test_candidates(spark):
    hits = spark.createDataFrame(
        [
            (1, 1, "ev_1", "A.pdf:p1", "x", {}, None, "low", "t" * 400), (1, 2, "ev_2", "A.pdf:p2", "immobilization_strategy", {"carrier": "ZIF-8", "immobilization_method": "adsorption", "pH": None}, [("yield", 90.5, "%"), (None, 1.0, "%"), ("x", None, "%")], None, "t"), (1, 3, "ev_5", None, "formulation_condition", {"pH": "7", "loading": "5"}, None, None, None),
            (2, 1, "ev_3", None, "x", None, None, None, "plain"), (3, 1, "ev_4", "B.pdf:p1", "x", {}, None, "high", "q"), (4, 1, "ev_6", "", "x", None, None, None, ""),
        ],
        KIND,
    )
    made_up = {"rank": 1, "strategy_summary": "s", "confidence": "sure", "evidence_ids": ["1", "ev_9"], "citations": ["B.pdf:p1"], "recommended_conditions": {"a": 1}, "risks": ["r"]}
    wrong = [{**made_up, "extra": 1}, {**made_up, "rank": "first"}, {**made_up, "risks": [1]}, {k: v for k, v in made_up.items() if k != "rank"}]
    answers = spark.createDataFrame([(1, '[{"rank": 1, "strategy_summary": "made up", "evidence_ids": ["ev_fake"]}]'), (3, json.dumps([made_up, *wrong])), (2, "broken"), (4, None)], "group_id int, candidates string")
    got = {r.group_id: r for r in candidates.candidates(answers, hits).collect()}
    assert (got[1].origin, got[1].strategy_summary, got[1].evidence_ids, got[1].expected_benefits) == ("evidence", "adsorption on ZIF-8", ["ev_2"], ["yield: 90.5%"])
    assert got[1].recommended_conditions == {"pH": None, "loading": "5"} and got[1].immobilization_method == "adsorption"
    assert (got[2].origin, got[2].strategy_summary, got[2].confidence) == ("fallback", "plain", "low") and got[4].strategy_summary == "retrieved evidence"
    assert (got[3].origin, got[3].confidence, got[3].evidence_ids, got[3].citations, got[3].recommended_conditions, got[3].risks) == ("generated", "medium", ["ev_4"], ["B.pdf:p1"], {"a": "1"}, ["r"])


def test_what_stands_beside(spark):
    none = F.lit(None).cast("array<string>")
    row = spark.range(1).select(
        candidates.merged(F.expr("map('a', '1', 'b', NULL)"), F.expr("map('b', '2', 'c', '3')")).alias("m"), candidates.limitations(F.array(F.lit(" x "), F.lit("x"), F.lit("")), F.lit(0), F.lit(True)).alias("l"), candidates.change_limitations(none, F.lit(2), F.lit(False), F.lit(0)).alias("cl"),
        candidates.experiments(F.lit('{"next_experiment_suggestions": [{"a": 1}, " do it ", "", 5]}'), none, F.lit(0)).alias("e"), candidates.experiments(F.lit("broken"), F.array(F.lit("A"), F.lit(None), F.lit("B"), F.lit("C")), F.lit(4)).alias("u"), candidates.change_experiments(F.lit(None).cast("string"), none, none).alias("c"),
        candidates.answer_id(F.lit("BCL"), F.lit("o"), F.array(*[F.lit(f"ev_{i}") for i in range(7)])).alias("r"), candidates.answer_id(F.lit("BCL"), F.lit("o"), F.array(F.lit("ev_0")), F.lit('{"a": 1}')).alias("o"),
    ).head()
    assert row.m == {"a": "1", "b": None, "c": "3"} and row.l == ["x", candidates.NO_EVIDENCE, candidates.TO_REVIEW] and row.cl == [candidates.NO_CHANGES, candidates.NO_OPTIMUM]
    assert row.e[:2] == ['{"a":1}', '{"suggestion":"do it"}'] and json.loads(row.u[0])["evidence_basis"] == ["A", "B"] and json.loads(row.c[0])["variables"] == list(candidates.CHANGE_VARIABLES)
    assert row.r == "rec_" + hashlib.sha1(b"BCL|o|ev_0,ev_1,ev_2,ev_3,ev_4").hexdigest()[:12] and row.o == "opt_" + hashlib.sha1(b'BCL|o|{"a": 1}|ev_0').hexdigest()[:12]


def test_generator():
    request = generate.Request([generate.Message("user", "hello")], response_format="json")
    maker = generate.GENERATORS["offline"]()
    assert generate.accumulate(maker.stream(request)) == (maker.generate(request), "stop")
    with pytest.raises(ValueError):
        generate.Message("user", "  ")
    with pytest.raises(ValueError):
        generate.Request([], 0.1)


def test_settings(tmp_path):
    tree = settings.parse("# c\na:\n  b: 1\n  c:\n    d: 'x y'  # t\ne: true\nf: 1.5\n")
    assert tree == {"a": {"b": 1, "c": {"d": "x y"}}, "e": True, "f": 1.5}
    (tmp_path / "s.yaml").write_text("dimensions: 768\ntop_k: 5\n")
    assert settings.load(str(tmp_path / "s.yaml")).dimensions == 768
    with pytest.raises(ValueError):
        settings.Settings(dimensions=5)
    with pytest.raises(ValueError):
        settings.parse("nothing")
