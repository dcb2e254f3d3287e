from types import SimpleNamespace

import numpy as np
from conftest import words  # noqa: F401  (pytest puts this folder on the path)

from voxelry.llm import substring_dedup as S
from voxelry.llm import words as W


def expected(rows, window):
    first = {}
    for d, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(d, first.get(g, d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < d:
                gone[k : k + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def test_against_brute_force(docs, texts):
    for window, gram in ((50, 8), (5, 2), (7, 7), (1, 1)):
        got = S.deduplicated(docs, window=window, gram=gram).collect()
        assert sorted(tuple(r) for r in got) == expected(texts, window)


def test_large_partitions_are_cut_into_slices(docs, texts, monkeypatch):
    from conftest import words  # noqa: F401

    whole = S.deduplicated(docs, window=10, gram=3)
    before = sorted(map(tuple, whole.collect()))
    blobs = []
    monkeypatch.setattr(S, "PARTITION_BYTES", 100)
    monkeypatch.setattr(S, "SEND_BYTES", 1000)
    import pyarrow as pa

    rows = [(d, 0, t) for d, t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "key", "text"])
    none, all_ = (SimpleNamespace(value=np.arange(n, dtype=np.int32)) for n in (0, S.COUNTERS))
    blobs = list(S._send(none, 10, 3, 1)([batch]))
    small = sorted(x for b in S._receive(10)(blobs) for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
    monkeypatch.undo()
    large = sorted(x for b in S._receive(10)(S._send(none, 10, 3, 1)([batch])) for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
    cover = lambda runs: {(d, w) for d, _, a, n in runs for w in range(a, a + n)}
    # The same with every minimiser hot, so that the second order routes all windows.
    again = sorted(x for b in S._receive(10)(S._send(all_, 10, 3, 1)([batch])) for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
    assert cover(small) == cover(large) == cover(again) and before


def test_a_phrase_in_most_windows_is_hot(spark, monkeypatch):
    """One phrase everywhere: its counter is found, and the result stays exact."""
    monkeypatch.setattr(S, "LEAST_HOT", 100)
    rows = [(k, " ".join(f"w{(k * 7 + j) % 61 if k % 3 else j % 5} the very common phrase of all" for j in range(12))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert len(S.hot_keys(docs, 20, 3))
    got = S.deduplicated(docs, window=20, gram=3).collect()
    assert sorted(map(tuple, got)) == expected(rows, 20)


def test_copies_in_any_order(monkeypatch):
    """Of equal strings the smallest document stays, whenever it comes, at each place of it."""
    s = S.Strings(2)
    add = lambda d, at: s.add(np.array([d]), np.array([0]), np.array([at]), np.array([1], np.uint64), [b"a b c"])
    for d, at in ((5, 0), (5, 9), (7, 1), (3, 4), (3, 8), (9, 2)):
        add(d, at)
    assert sorted(x[::2] for x in s.repeats) == [(5, 0), (5, 9), (7, 1), (9, 2)] and all(x[3] == 2 for x in s.repeats)
    assert s.held == {b"a b c": (3, [(0, 4), (0, 8)], 1)}


def test_documents_that_share_a_bit(docs, texts, monkeypatch):
    """Whether or not other documents share a bit with those that have repeats."""
    for bits in (8, 64):
        monkeypatch.setattr(S, "BITS", bits)
        assert sorted(map(tuple, S.deduplicated(docs, window=10, gram=3).collect())) == expected(texts, 10)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(W, "mixed", lambda x: np.zeros(len(x), np.uint64))
    code = np.array([1, 2, 3, 9, 1, 2, 3, 4, 4, 4], np.int32)
    owner, at = S._same_windows(code, np.array([0, 4, 7, 10]), np.array([5, 7, 6]), 3)
    assert list(zip(owner.tolist(), at.tolist(), strict=True)) == [(1, 4)]


def test_empty_table(none):
    assert S.deduplicated(none).count() == 0
