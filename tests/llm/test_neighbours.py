import numpy as np
from pyspark.sql import functions as F

from tidegrid.llm import neighbours, queries


def exact(rows, asked, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q in asked:
        d = np.sqrt(((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def test_query_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = exact(rows, [i for i, _ in rows if i % 100 == 0])
    got = {}
    for r in queries.op8(spark, sf).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(want)
    assert all(sorted(g) == list(range(1, 11)) for g in got.values())
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    vec = dict(rows)
    for q, g in got.items():
        for v, s in g.values():
            assert abs(s - np.sqrt(((np.array(vec[q], float) - np.array(vec[v], float)) ** 2).sum())) < 1e-12


def test_clusters_need_narrow_windows_only(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(scale=0.02, size=16)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = exact(rows, range(0, 4000, 200))
    got = neighbours.nearest(df, F.col("id") % 200 == 0, window=0.05, curves=8).collect()
    hits = sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in got)
    assert hits / (10 * len(want)) >= 0.9


def test_common_vector_gives_its_smallest_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(5000 + i, [float(i), 1.0, 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("id").isin(0, 2999, 5000), k=10).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 2999)}
    assert by[0] == list(range(1, 11)) and by[2999] == list(range(10))


def test_unusable_rows_repeats_and_empty_table(spark):
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
        (6, [float("inf"), 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [1.0, 1.0]), (10, [1.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "v": F.lit("x"), "rank": F.lit(1)})
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(df, F.lit(True)).collect())
    assert [x for x in got if x[0] == 0] == [(0, 1, 1), (0, 2, 9), (0, 3, 10)]
    assert {x[0] for x in got} == {0, 1, 9, 10}
    assert neighbours.nearest(df.where("vec_id = 99"), F.lit(True)).collect() == []


def test_hilbert_keys_are_a_walk_over_the_grid():
    cells = np.array([[a, b, c] for a in range(4) for b in range(4) for c in range(4)])
    path = cells[np.argsort(neighbours.hilbert(cells, 2))]
    assert sorted(neighbours.hilbert(cells, 2)) == list(range(64))
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_a_third_of_all_rows_in_one_tight_cluster(spark):
    for spread in (1e-5, 1e-3):
        rng = np.random.default_rng(4)
        x = rng.normal(size=(6000, 64))
        x /= np.sqrt((x**2).sum(1, keepdims=True))
        x[::3] = x[0] + rng.normal(scale=spread, size=(2000, 64))
        rows = list(enumerate(x.tolist()))
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        asked = range(0, 6000, 60)
        want = exact(rows, asked)
        got = neighbours.nearest(df, F.col("id") % 60 == 0).collect()
        assert len(got) == 10 * len(want)
        hits = sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in got)
        assert hits / len(got) >= 0.9


def best_of(v, ids, asked, k, parts=1):
    best = neighbours._Best(ids[asked], v[asked], k)
    for part in np.array_split(np.arange(len(v)), parts):
        best.add(ids[part], v[part])
    return best.result()


def plain_best(v, ids, i, k):
    d = np.sqrt(((v - v[i]) ** 2).sum(1))
    d[i] = np.inf
    order = np.lexsort((ids, d))[:k]
    return ids[order].tolist(), d[order]


def test_blocks_find_all_far_from_the_origin():
    rng = np.random.default_rng(1)
    ids, asked = rng.permutation(3000), np.arange(0, 3000, 60)
    tight = rng.normal(size=(3000, 16))
    mixed = tight * np.where(np.arange(3000) % 3, 1e-9, 1)[:, None] + np.where(np.arange(3000) % 3, 1e4, 0)[:, None]
    for v in (tight * 1e-3 + 1e6, tight, mixed, np.repeat(tight[:100], 30, axis=0)):
        for parts in (1, 4):
            query, found, score = best_of(v, ids, asked, 10, parts)
            for i in asked:
                who, d = plain_best(v, ids, i, 10)
                mine = query == ids[i]
                assert found[mine].tolist() == who and (score[mine] == d).all()


def test_huge_components_keep_their_neighbours(spark):
    rng = np.random.default_rng(2)
    for size in (1e150, 1e200, 1e300):
        rows = rng.normal(size=(60, 4)) * size
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
        got = neighbours.nearest(df, F.col("id") % 10 == 0, k=5).collect()
        small = rows / 2.0**600
        for i in range(0, 60, 10):
            mine = sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)
            who, d = plain_best(small if size > 1e150 else rows, np.arange(60), i, 5)
            assert [r.vec_id for r in mine] == who
            assert np.allclose([r.score for r in mine], d * (2.0**600 if size > 1e150 else 1), rtol=1e-12)
