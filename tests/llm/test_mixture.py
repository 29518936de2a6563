import numpy as np

from lodestone.llm.mixture import mix, rake


def test_rake_meets_goals_within_caps():
    draw = np.random.default_rng(4)
    tokens, source, language, topic = draw.uniform(10, 500, 60), np.repeat(np.arange(3), 20), np.tile(np.arange(4), 15), draw.integers(0, 5, 60)
    goals, caps = np.array([0.5, 0.3, 0.2]) * tokens.sum() * 0.8, np.array([3.0, 2.0, 4.0])
    weights = rake(tokens, source, language, topic, goals, caps)
    assert np.allclose(np.bincount(source, tokens * weights), goals, rtol=1e-6)
    assert (weights <= caps[source] + 1e-9).all()
    want = np.bincount(language, tokens) / tokens.sum()
    assert np.abs(np.bincount(language, tokens * weights) / goals.sum() - want).max() < 0.02


def test_shares(spark):
    rows = [(i, f"text number {i} of some words " * (1 + i % 7), "big" if i % 3 else "small", "en" if i % 2 else None, f"t{i % 5}") for i in range(900)]
    rows += [(9001, None, "big", "en", "t1"), (9002, "", "big", "en", "t1"), (9003, "other", None, "en", "t1"), (9004, "else", "unlisted", "en", "t1"), (9005, "rare", "tiny", "zh", None)]
    df = spark.createDataFrame(rows, "k bigint, x string, source string, lang string, topic string")
    targets = spark.createDataFrame([("big", 0.45, 1), ("small", 0.45, 3), ("tiny", 0.1, 2), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixture, shares = mix(df, targets, "k", "x", "source", "lang", "topic")
    used = mixture.toPandas()
    assert used.k.is_unique and set(used.k) <= set(range(900)) | {9005}
    assert used[used.source == "big"].uses.max() == 1 and used[used.source == "small"].uses.max() <= 3 and used[used.source == "tiny"].uses.tolist() == [2]
    report = shares.toPandas().set_index("source")
    goal = 0.45 * report.available_tokens.sum()
    assert report.capped.to_dict() == {"big": False, "small": False, "tiny": True, "absent": False}
    assert abs(report.mixed_tokens["big"] / goal - 1) < 0.01 and abs(report.mixed_tokens["small"] / goal - 1) < 0.01
    assert abs(report.actual_share.sum() - 1) < 1e-9
    assert mix(df.limit(0), targets, "k", "x", "source", "lang", "topic")[1].count() == 4


def test_attainable_size():
    from lodestone.llm.mixture import attainable_total

    available, shares, caps = np.array([100.0, 10.0, 5.0]), np.array([0.5, 0.5, 0.0]), np.array([1.0, 4.0, 1.0])
    assert attainable_total(available, shares, caps) == 80.0
    assert attainable_total(np.array([100.0, 0.0]), np.array([0.5, 0.5]), np.array([1.0, 4.0])) == 200.0 and attainable_total(np.zeros(2), np.array([0.5, 0.5]), np.ones(2)) == 0.0


def test_sizes_at_which_shares_hold(spark):
    rows = [(i, f"text number {i} of some words " * (1 + i % 7), "big" if i % 5 else "small", "en", "t") for i in range(600)]
    df = spark.createDataFrame(rows, "k bigint, x string, source string, lang string, topic string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 1), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    report = mix(df, targets, "k", "x", "source", "lang", "topic", "attainable")[1].toPandas().set_index("source")
    assert abs(report.mixed_tokens["big"] / report.mixed_tokens["small"] / 1.25 - 1) < 0.02 and not report.capped["small"] and not report.capped["big"]
    nothing = mix(df, targets, "k", "x", "source", "lang", "topic", 0)
    assert nothing[0].count() == 0 and nothing[1].count() == 3
