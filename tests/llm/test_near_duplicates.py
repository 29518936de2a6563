import itertools
import random

import numpy as np
import pytest

from lodestone.llm.near_duplicates import SAMPLES, _minima, near_duplicate_groups, near_duplicate_pairs, odd_sketches, sketch_similarity, string_values, word_set

KIND = "field string, id string, text string, is_json boolean, rid int"


def corpus(seed=3, texts=60, copies=4):
    draw = random.Random(seed)
    common = [f"word{i}" for i in range(40)]
    rows = []
    for n in range(texts):
        words = draw.sample(common, 12) + [f"code{draw.randrange(10**6)}" for _ in range(draw.randint(8, 25))]
        for c in range(copies):
            edited = words[:]
            for _ in range(draw.randint(0, 4)):
                edited[draw.randrange(len(edited))] = f"edit{draw.randrange(10**6)}"
            draw.shuffle(edited)
            rows.append(("f", f"t{n:03}_{c}", " ".join(edited), False, n))
    return rows


def brute(rows, threshold=0.75):
    sets = {}
    for field, key, text, is_json, _ in rows:
        if text is not None and (words := word_set(string_values(text) if is_json else text)):
            sets.setdefault((field, key), []).append(words)
    pairs = set()
    for (a, va), (b, vb) in itertools.combinations(sorted(sets.items()), 2):
        if a[0] == b[0] and any(len(x & y) >= threshold * len(x | y) for x in va for y in vb):
            pairs.add((a[0], a[1], b[1]))
    return pairs


@pytest.fixture(params=[2048, 30, 3])
def hot(request, monkeypatch):
    """Words in more sets than this are hot."""
    monkeypatch.setattr("lodestone.llm.near_duplicates.HOT", request.param)
    monkeypatch.setattr("lodestone.llm.near_duplicates.LOADS", 0)
    return request.param


def test_same_pairs_as_brute_force(spark, hot):
    rows = corpus() + [("g", "n1", None, False, 0), ("g", "n2", "", False, 0), ("g", "n3", "...", False, 0), ("g", "n4", "same text", False, 0), ("g", "n5", "Text  SAME!", False, 0), ("g", "n5", "Text  SAME!", False, 0)]
    rows += [("j", "j1", '{"a": "x y z", "b": ["w", {"c": "v"}]}', True, 0), ("j", "j2", '{"b": ["W", {"c": "v"}],  "q": "z y x"}', True, 0), ("j", "j3", "{}", True, 0), ("j", "j4", "{broken", True, 0)]
    found = {tuple(r) for r in near_duplicate_pairs(spark.createDataFrame(rows, KIND)).collect()}
    assert found == brute(rows)
    assert ("g", "n4", "n5") in found and ("j", "j1", "j2") in found


def test_groups_are_the_connected_ids(spark):
    rows = corpus(9, 12, 4)
    parent = {r[1]: r[1] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, a, b in brute(rows):
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    found = {r.id: r.group_id for r in near_duplicate_groups(spark.createDataFrame(rows, KIND)).collect()}
    assert found == {x: root(x) for x in parent}


def test_chain_of_links(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [("f", f"c{i:02}", " ".join(words[i : i + 20]), False, 0) for i in range(30)]
    assert {r.group_id for r in near_duplicate_groups(spark.createDataFrame(rows, KIND)).collect()} == {"c00"}


def test_empty(spark):
    assert near_duplicate_pairs(spark.createDataFrame([], KIND)).count() == 0
    assert near_duplicate_groups(spark.createDataFrame([], KIND)).count() == 0


@pytest.mark.parametrize("shared", [60, 75, 90])
def test_sketches_estimate_similarity(shared):
    draw, found = np.random.default_rng(1), []
    for _ in range(60):
        both, a, b = (draw.integers(0, 2**63, n, dtype=np.uint64) for n in (shared, (100 - shared) // 2, (100 - shared) // 2))
        sketch = odd_sketches(np.concatenate([_minima(np.concatenate([both, x]), np.array([0]), 0, SAMPLES) for x in (a, b)], axis=1))
        found.append(sketch_similarity(sum(int(x).bit_count() for x in sketch[0] ^ sketch[1])))
    assert abs(np.mean(found) - shared / (shared + 2 * ((100 - shared) // 2))) < 0.05


@pytest.mark.parametrize("inserted", [18, 24, 28])
def test_words_inserted_on_one_side(spark, hot, inserted):
    """The copies' words are hot, so a variant with many rare words more meets them only by the bands over hot words."""
    draw = random.Random(inserted)
    base = [f"base{i}" for i in range(84)]
    rows = [("f", f"b{i:02}", " ".join(base[:i] + base[i + 1 :]), False, 0) for i in range(40)]
    rows += [("f", f"v{i:02}", " ".join(base + [f"new{i}x{j}" for j in range(inserted)]), False, 0) for i in range(12)]
    rows += [("f", f"o{i:02}", " ".join(f"other{draw.randrange(10**6)}" for _ in range(40)), False, 0) for i in range(60)]
    want = brute(rows)
    assert ("f", "b00", "v00") in want or inserted == 28
    assert {tuple(r) for r in near_duplicate_pairs(spark.createDataFrame(rows, KIND)).collect()} == want


def test_hot_words_shared_by_all(spark, hot):
    """Texts of the same few words: everything they share is hot."""
    draw = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    rows = [("f", f"s{i:03}", " ".join(draw.sample(words, draw.randint(14, 24)) + [f"own{i}x{j}" for j in range(draw.choice([0, 1, 5]))]), False, 0) for i in range(120)]
    assert {tuple(r) for r in near_duplicate_pairs(spark.createDataFrame(rows, KIND)).collect()} == brute(rows)
