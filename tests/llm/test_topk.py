import math
import random

from voxelry.llm import topk as K


def expected(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in sorted(ok, reverse=True)}.items():
        if q % 10 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(b) == len(a))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(9)]) for i in range(60)]
    rows += [(100 + i, rows[10][1]) for i in range(30)]  # ties
    rows += [(200, None), (201, [None] * 9), (202, [float("nan")] * 9), (203, [float("inf")] + [0.0] * 8), (None, rows[0][1]), (210, [1.0]), (220, [2.0]), (230, [])]
    rows += [rows[3], rows[3]]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(6)
    vectors = K.scaled(frame)
    for block in (K.BLOCK_VALUES, 20):
        monkeypatch.setattr(K, "BLOCK_VALUES", block)
        for k in (10, 3, 500):
            got = K.top_k(vectors, vectors.filter("vec_id % 10 = 0"), k=k)
            assert sorted(map(tuple, got.collect())) == expected(rows, k)
    assert K.top_k(vectors.filter("false"), vectors.filter("false")).count() == 0


def test_large_components_are_exact(spark):
    rows = [(0, [1e13, -3e12]), (1, [2e12, 7e11]), (2, [-1e13, 5e3])]
    vectors = K.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r.vec_id: r.score for r in K.top_k(vectors, vectors.filter("vec_id = 0")).collect()}
    top, low = (1 << 63) - 1, -(1 << 63)
    want = {i: max(low, min(top, sum(math.floor(1024 * x) * math.floor(1024 * y) for x, y in zip(rows[0][1], v, strict=True)))) for i, v in rows[1:]}
    assert got == want
