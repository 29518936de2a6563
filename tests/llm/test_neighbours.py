import numpy as np
import pytest

from lodestone.llm.neighbours import VantageTree, nearest, neighbour_pairs, search

KIND = "k bigint, v array<double>, neighbour int"


def clustered(count=900, size=16, seed=2):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(count // 12, size))
    return (centres[draw.integers(0, len(centres), count)] + 0.25 * draw.normal(size=(count, size))) * draw.uniform(0.2, 4, (count, 1))


def truth(vectors, k):
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    scores = units @ units.T
    np.fill_diagonal(scores, -3)
    return [set(r) for r in np.argsort(-scores, axis=1)[:, :k]]


@pytest.mark.parametrize("factor, least", [(1.0, 1.0), (4.0, 0.95)])
def test_tree(factor, least):
    units = clustered()
    units = (units / np.linalg.norm(units, axis=1)[:, None]).astype(np.float32)
    tree = VantageTree(units, 32)
    best = search(tree, tree.order, units, np.arange(len(units)), 5, factor)
    assert np.mean([len(t & set(b)) / 5 for t, b in zip(truth(units, 5), best.ids.tolist())]) >= least


@pytest.mark.parametrize("factor, least", [(1.0, 1.0), (4.0, 0.95)])
def test_shards(spark, factor, least):
    vectors = clustered()
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], KIND)
    got = nearest(df, "k", "v", 16, 5, factor, shard=150).toPandas().groupby("k").neighbour.apply(set)
    assert np.mean([len(t & got[i]) / 5 for i, t in enumerate(truth(vectors, 5))]) >= least
    assert got.map(len).eq(5).all()


@pytest.mark.parametrize("noise, factor, least", [(1e-3, 1.0, 1.0), (1e-6, 1.0, 0.999), (1e-3, 4.0, 0.9)])  # at 1e-6 the cosines of brute force are themselves rounded
def test_half_of_all_vectors_near_one_another(spark, noise, factor, least):
    draw = np.random.default_rng(6)
    vectors = np.concatenate([draw.normal(size=16) + noise * draw.normal(size=(700, 16)), draw.normal(size=(700, 16))])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], KIND)
    got = nearest(df, "k", "v", 16, 5, factor, shard=150).toPandas().groupby("k").neighbour.apply(set)
    assert np.mean([len(t & got[i]) / 5 for i, t in enumerate(truth(vectors, 5))]) >= least


def test_sliced_questions(spark, monkeypatch):
    monkeypatch.setattr("lodestone.llm.neighbours.SLICE", 1)
    vectors = clustered()
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], KIND)
    got = nearest(df, "k", "v", 16, 5, 1.0, shard=60).toPandas().groupby("k").neighbour.apply(set)
    assert [got[i] for i in range(len(vectors))] == truth(vectors, 5)


def test_hot_vector_and_unusable_ones(spark):
    rows = [(i, [1.0, 0.0, 0.0], 0) for i in range(300)] + [(1000, None, 0), (1001, [], 0), (1002, [0.0, 0.0, 0.0], 0), (1003, [1.0, 2.0], 0), (1004, [1.0, None, 0.0], 0), (1005, [float("nan"), 1.0, 1.0], 0), (1006, [0.0, 5.0, 0.0], 0)]
    got = nearest(spark.createDataFrame(rows, KIND), "k", "v", 3, 5, shard=40).toPandas()
    assert set(got.k) == {*range(300), 1006}
    assert (got.k != got.neighbour).all() and got.groupby("k").neighbour.nunique().eq(5).all()


def test_small_and_empty(spark):
    two = spark.createDataFrame([(7, [1.0, 0.0], 0), (9, [0.5, 0.5], 0)], KIND)
    assert [tuple(r) for r in neighbour_pairs(two, "k", "v", 2).collect()] == [(7, 9)]
    assert nearest(two.limit(1), "k", "v", 2).count() == 0
    assert nearest(two.limit(0), "k", "v", 2).count() == 0


def test_outlying_vectors_beside_a_tight_cluster(spark):
    """Where near-copies fill a shard, the few others in it still ask every shard their ball touches."""
    draw = np.random.default_rng(4)
    centre = np.zeros(16)
    centre[0] = 1
    vectors = np.concatenate([centre + 0.05 * draw.normal(size=(1192, 16)), draw.normal(size=(8, 16))])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], KIND)
    got = nearest(df, "k", "v", 16, 5, 1.01, shard=150).toPandas().groupby("k").cosine.min()
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    fifth = np.sort(units[1192:] @ units.T, axis=1)[:, -6]
    assert (got[range(1192, 1200)].to_numpy() >= fifth - 0.01).all()  # the factor leaves out what is closer by a hundredth at most
