import numpy as np
import pytest
from pyspark.sql import functions as F

from talloom.llm import quantised
from talloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, node string, tab string, h1 string, salt string"


def brute(rows, cosine=0.95):
    """vec_id, n_links, component_id, kept of (vec_id, vector) rows, from all pairs."""
    good = [i for i, (_, v) in enumerate(rows) if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    size = max((len(rows[i][1]) for i in good), key=[len(rows[i][1]) for i in good].count, default=0)
    good = [i for i in good if len(rows[i][1]) == size]
    near = np.zeros((len(rows),) * 2, bool)
    if good:
        x = np.array([rows[i][1] for i in good], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        near[np.ix_(good, good)] = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    root = list(range(len(rows)))
    for start in range(len(rows)):
        stack = [start] if root[start] == start else []
        while stack:
            for j in np.flatnonzero(near[stack.pop()]).tolist():
                if root[j] > start:
                    root[j] = start
                    stack.append(j)
    name = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            name[r] = min(name.get(r, rows[i][0]), rows[i][0])
    return sorted([(rows[i][0], int(near[i].sum()), name.get(root[i]), rows[i][0] == name.get(root[i])) for i in range(len(rows))], key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "n", "t", "h", "s") for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def planted():
    """Random directions, families of near copies on both sides of the threshold, and copies."""
    rng = np.random.default_rng(1)
    vectors = list(rng.normal(size=(1500, 64)))
    for size, noise in ((2, 0.1), (5, 0.2), (40, 0.03), (400, 0.12), (60, 0.24), (30, 0.3)):
        base = rng.normal(size=64)
        vectors += list(base + noise * rng.normal(size=(size, 64)))
    vectors += [vectors[3]] * 300 + [vectors[1510]] * 7
    order = rng.permutation(len(vectors))
    return [(int(i), np.float32(vectors[k]).tolist()) for i, k in enumerate(order)]


def test_recall_and_precision_on_planted_families(spark, planted, monkeypatch):
    monkeypatch.setattr(quantised, "BLOCK", 100)  # families lie in several blocks
    want, found = brute(planted), got(quantised.near_duplicates(table(spark, planted)))
    true, links = np.array([r[1] for r in want]), np.array([r[1] for r in found])
    assert (links <= true).all() and links.sum() >= 0.998 * true.sum() > 100_000
    assert np.mean([a[2] == b[2] for a, b in zip(want, found)]) > 0.99


def test_vectors_in_a_narrow_cone(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (10 + rng.normal(size=16)).tolist()) for i in range(300)]
    assert got(quantised.near_duplicates(table(spark, rows))) == brute([(i, np.float32(v).tolist()) for i, v in rows])


def test_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(QUERIES["op12_quantised_links"](spark, sf)) == brute(rows)


def test_odd_vectors(spark):
    one = [1.0] + [0.0] * 7
    rows = [
        (1, one), (2, one), (2, one), (3, [-0.0 + x for x in one]), (4, [2.0] + [0.0] * 6 + [-0.0]), (None, one), (None, None),
        (5, None), (6, [0.0] * 8), (7, [float("nan")] + one[1:]), (8, [float("inf")] + one[1:]), (9, [None] + one[1:]), (10, []),
        (11, [1.0, 0.0]), (12, [-1.0] + [0.0] * 7), (13, [1e-30] + [0.0] * 7), (14, [1.0, 0.3] + [0.0] * 6), (14, [0.0, 1.0] + [0.0] * 6),
    ]
    frame = table(spark, rows)
    want = [(None if r[0] is None else r[0], r[1], r[2], r[0] == r[2]) for r in brute([(i, None if v is None or not v else v) for i, v in rows])]
    assert got(quantised.near_duplicates(frame)) == sorted(want, key=str)
    assert got(quantised.near_duplicates(frame.where("vec_id > 100"))) == []
    assert got(quantised.near_duplicates(frame.where("vec_id = 5"))) == [(5, 0, 5, True)]
    assert quantised.near_duplicates(frame.withColumn("embedding", F.col("embedding").cast("array<double>"))).count() == len(rows)
