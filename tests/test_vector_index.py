"""Vector search by cells against plain products."""

import numpy as np
import pytest

from factgraph.operators import vector_index


def rows_of(kind):
    rng = np.random.default_rng(8)
    if kind == "clusters":
        centres = rng.normal(size=(12, 16))
        v = (centres[rng.integers(0, 12, 900)] + 0.2 * rng.normal(size=(900, 16))).tolist()
    elif kind == "copies":
        v = [[1.0, 0.0, 0.5]] * 300 + rng.normal(size=(100, 3)).tolist()
    else:
        v = [[0.0, 0.0], None, [], [1.0, None], [float("nan"), 1.0], [3.0, 4.0], [0.6, 0.8], [-1.0, 0.0]]
    return list(enumerate(v))


def plain(x, wide):
    v = np.zeros(wide)
    for i, a in enumerate(x or []):
        v[i] = a if a is not None and np.isfinite(a) else 0.0
    return v / max(np.linalg.norm(v), 1e-300)


@pytest.mark.parametrize("kind", ["clusters", "copies", "awkward"])
@pytest.mark.parametrize("k, least, block", [(5, 0.1, 8192), (3, -1.0, 40), (7, 0.9, 64)])
def test_exact_search(spark, kind, k, least, block):
    """Ties go to the smaller id; null, empty, zero and not-finite vectors have no direction, so cosine 0."""
    rows = rows_of(kind)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = df.filter("vec_id % 5 = 0 OR vec_id < 8")
    got = {(r.query_id, r.place, r.vec_id, r.score) for r in vector_index.build(df, block=block).search(asked, k, least, probes=2).collect()}
    wide = max(len(v or []) for _, v in rows)
    units = np.array([plain(v, wide) for _, v in rows])
    want = set()
    for q, _ in rows:
        if q % 5 == 0 or q < 8:
            scores = sorted(((-round(float(s), 6) + 0.0, i) for i, s in enumerate(units @ units[q]) if i != q and round(float(s), 6) >= least))[:k]
            want |= {(q, place + 1, i, -s + 0.0) for place, (s, i) in enumerate(scores)}
    assert {(q, p) for q, p, _, _ in got} == {(q, p) for q, p, _, _ in want}
    if kind != "clusters":
        assert {x[:3] for x in got} == {x[:3] for x in want}
    assert np.allclose([x[3] for x in sorted(got)], [x[3] for x in sorted(want)], atol=2e-6)


def test_cells_alone_find_most(spark):
    df = spark.createDataFrame(rows_of("clusters"), "vec_id long, embedding array<double>")
    index, asked = vector_index.build(df), df.filter("vec_id % 20 = 0")
    true = {(r.query_id, r.vec_id) for r in index.search(asked, 10, -1.0).collect()}
    near = {(r.query_id, r.vec_id) for r in index.search(asked, 10, -1.0, exact=False).collect()}
    assert len(true) == 450 and len(true & near) >= 0.9 * len(true)


def test_no_vectors(spark):
    none, one = (spark.createDataFrame(x, "vec_id long, embedding array<double>") for x in ([], [(1, [1.0, 2.0])]))
    assert vector_index.build(none).search(one, 3, -1.0).collect() == []
    assert vector_index.build(one).search(none, 3, -1.0).collect() == []


def test_a_query_that_asks_every_block_is_repeated_in_pieces():
    """4,000 cells of two blocks each are all asked, by batches of bounded size."""
    import pyarrow as pa

    centroids = np.eye(4000, 8) + 1
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    v = [[1.0] + [0.0] * 7, [0.0] * 7 + [1.0]]
    asked = pa.record_batch([pa.array([3, 4]), pa.array(v), pa.array([-1.0, None])], ["query_id", "v", "floor"])
    got = list(vector_index._asked_cells(asked, centroids, np.full(4001, 2.0), np.full(4001, 2), 8, -1.0))
    assert max(x.num_rows for x in got) <= vector_index.PIECE
    rows = [x for b in got for x in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True)]
    assert len(set((c, p, q) for c, p, q, _ in rows)) == len(rows) == (4001 - 8) * 2 + 8 * 2
    assert all(x == v[q - 3] for _, _, q, x in rows)
