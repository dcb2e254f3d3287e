from voxelry.llm import line_dedup as L


def rows_of(spark, rows):
    return spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, lines int")


def own(k):
    return "\n".join(f"alpha{'abcdefghij'[(k * 7 + j) % 10]}{'klmnopqrst'[k % 10]}{'uvwxyzabcd'[k // 10]} beta gamma{'abcdefghij'[j]} delta word{'abcdefghij'[k % 10]} end" for j in range(4))


def test_templates(spark):
    rows = [(k, f"{own(k)}\nPage {k} of 17\n\nWritten by our staff member {'ann bob cyd dan eve fay gus hal ida jon kim lou'.split()[k]} in the office") for k in range(12)]
    rows += [(20, None), (21, ""), (22, own(40)), (None, "Page 9 of 17"), (23, "Page 4 of 17")]
    rows += [(30 + k, own(50) + "\nA line that only copies share") for k in range(9)]
    rows += [(50, "Page 1 of 17\nstays here"), (50, "Page 1 of 17\nstays here")]
    got = L.deduplicated(rows_of(spark, rows))
    assert got.columns == ["doc_id", "text", "lines", "__n_lines", "__n_dropped"]
    kept = {}
    for r in got.collect():
        kept.setdefault(r.doc_id, []).append(r.text)
    assert all(kept[k] == [own(k) + "\n"] for k in range(12))
    assert kept[20] == [None] and kept[21] == [""] and kept[22] == [own(40)] and kept[23] == [""]
    assert kept[None] == ["Page 9 of 17"]
    assert all(kept[30 + k] == [own(50) + "\nA line that only copies share"] for k in range(9))
    assert kept[50] == ["stays here"] * 2


def test_against_brute_force(docs, texts):
    """Exact templates only: counted by hand, with the families that the operator gives."""
    import re
    from collections import Counter

    hot = re.compile(r"Posted in this forum by user")
    for r in L.deduplicated(docs).collect():
        assert not hot.search(r.text or "")
    kept = Counter((r.doc_id, r.text) for r in L.deduplicated(docs).collect())
    changed = [d for d, t in texts if (d, t) not in kept]
    assert changed == list(range(80, 92))


def test_empty_table(none):
    assert L.deduplicated(none).count() == 0
