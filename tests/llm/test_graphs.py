import numpy as np

from millrace.llm import components, hnsw


def by_hand(rows, k=20, every=20):
    rows = sorted({r[0]: r[1] for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and any(r[1])}.items())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = x @ x[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, shard string").repartition(3)


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_LEAST", 700)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 2500)] + 0.4 * rng.normal(size=(2500, 24))) * rng.uniform(0.5, 2, (2500, 1))
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]
    expected = by_hand(rows)
    found = {}
    for r in hnsw.nearest(frame(spark, rows)).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert found.keys() == expected.keys()
    hit = 0
    for q, own in found.items():
        assert sorted(own) == list(range(1, 21))
        scores = [own[i][1] for i in range(1, 21)]
        assert scores == sorted(scores, reverse=True)
        assert np.allclose(scores, [x[q].astype(np.float32).astype(float) @ x[own[i][0]].astype(np.float32).astype(float) for i in range(1, 21)], rtol=1e-12)
        hit += len({v for v, _ in own.values()} & {v for v, _ in expected[q]})
    assert hit >= 0.9 * 20 * len(expected)


def test_odd_vectors_ties_and_copies(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(60 + i, [0.5, float(i)]) for i in range(41)]
    rows += [(200, None), (220, []), (240, [0.0, 0.0]), (260, [None, 1.0]), (280, [float("nan"), 1.0]), (300, [float("inf"), 1.0]), (320, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0])]
    found = {}
    for r in sorted(hnsw.nearest(frame(spark, rows)).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    expected = by_hand([r for r in rows if r[0] != 320])
    assert found == expected


def test_few_or_no_vectors(spark):
    assert hnsw.nearest(frame(spark, [])).count() == 0
    assert hnsw.nearest(frame(spark, [(20, [1.0, 2.0])])).count() == 0
    assert [tuple(r) for r in hnsw.nearest(frame(spark, [(20, [1.0, 2.0]), (1, [3.0, 4.0])])).collect()] == [(20, 1, 1, 11.0)]


def test_components_of_a_random_graph(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2300)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    expected = {x: top(x) for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()} == expected
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_doubles_keep_their_precision(spark):
    rows = [(i, [1.0 + i * 2.0**-40, 3.0 - i]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([r[1] for r in rows])
    for r in hnsw.nearest(frame).collect():
        assert r.score == float(x[r.query_id] @ x[r.vec_id])


def test_long_vectors_have_small_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(rng.normal(size=(120, 16)))]
    monkeypatch.setattr(hnsw, "SHARD_BYTES", 8 * 16 * 30)
    seen = []
    real = hnsw.build
    monkeypatch.setattr(hnsw, "build", lambda vectors, shards: seen.append(shards) or real(vectors, shards))
    expected = by_hand(rows)
    found = {}
    for r in hnsw.nearest(frame(spark, rows)).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert seen == [4]
    assert sum(len(found[q] & {v for v, _ in own}) for q, own in expected.items()) >= 0.9 * 20 * len(expected)
