from conftest import LOWER, words

from voxelry.llm import jaccard_join as J
from voxelry.llm.components import components


def expected(rows, gram, percent):
    sets = {}
    for d, t in rows:
        w = words((t or "").translate(LOWER))
        sets[d] = {tuple(w[k : k + gram]) for k in range(len(w) - gram + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), root(d)) for d, _ in rows)


def test_against_brute_force(docs, texts):
    for gram, percent in ((5, 80), (4, 85), (1, 50)):
        got = J.near_duplicates(docs, gram=gram, percent=percent)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == expected(texts, gram, percent)


def test_blocks_and_groups(docs, texts, monkeypatch):
    # Workers import the module afresh, so the block size is tried on the function itself.
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n = np.sort(rng.integers(50, 90, 40))
    cols = [np.zeros(40, np.int64), np.arange(40), n, rng.integers(0, 5, 40), np.arange(40) // 3, None]
    ranges = np.zeros((40, J.RANGES // 2), np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in ranges], pa.binary()) if c is None else pa.array(c) for c in cols], ["token", "doc_id", "n", "at", "component", "ranges"])
    pairs = lambda: sorted(x for b in J._cross_pairs(80)([batch]) for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
    whole = pairs()
    monkeypatch.setattr(J, "BLOCK", 7)
    assert pairs() == whole and whole and len(set(whole)) == len(whole)


def test_long_lists_are_dealt_out(docs, texts, monkeypatch):
    """Every list is long, every shingle hot, and no table is small enough to be broadcast."""
    from voxelry.llm import store

    monkeypatch.setattr(J, "BLOCK", 2)
    monkeypatch.setattr(J, "HOT", 0)
    monkeypatch.setattr(store, "BROADCAST_ROWS", 0)
    got = J.near_duplicates(docs, gram=4, percent=70)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == expected(texts, 4, 70)


def test_parts_of_a_list_find_all_pairs(spark, monkeypatch):
    """Pairs across components of a list that is dealt out, against all pairs of the list."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    size = 120
    n, at, component = rng.integers(20, 60, size), rng.integers(0, 4, size), np.where(np.arange(size) < 90, 0, np.arange(size) // 4)
    rows = [(7, k, int(n[k]), int(at[k]), int(component[k])) for k in range(size)]
    frame = spark.createDataFrame(rows, "token long, doc_id long, n int, at int, component long")
    join = J.Join.__new__(J.Join)
    join.percent = 80
    blank = b"\0" * (J.RANGES // 2)
    join.with_ranges = lambda f: f.withColumn("ranges", F.lit(blank))
    told = lambda: sorted({(r.a, r.b) for r in join.cross_pairs(frame).collect()})
    whole = told()
    want = []
    for a in range(size):
        for b in range(a + 1, size):
            if component[a] != component[b] and J._may_link(80, *(np.array([x]) for x in (n[a], at[a], n[b], at[b])))[0]:
                want.append((a, b))
    assert whole == want
    monkeypatch.setattr(J, "BLOCK", 8)
    assert told() == want


def test_one_of_each_group_stays(docs, texts, none):
    want = expected(texts, 5, 80)
    kept = J.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, c in want if d == c)
    assert J.near_duplicates(none).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 102)], "a long, b long").repartition(7)
    got = {r.doc_id: r.component for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}
