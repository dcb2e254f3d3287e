import hashlib

from conftest import terms

from voxelry.llm import decontaminate as D

ITEMS = [(1, None), (2, ""), (3, "one TWO"), (4, "Posted in this forum"), (5, "the same words the same words the same words the same words"), (6, "nowhere to be found in any of these texts at all"), (None, "one two")]


def expected(rows, items, window):
    known = {}
    for i, t in items:
        w = terms(t)
        if i is not None and w:
            for k in range(max(1, len(w) - window + 1)):
                known.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, own = terms(t), set(), set()
        for g, i in known.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    own |= i
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_against_brute_force(spark, docs, texts):
    items = ITEMS + [(7, texts[10][1]), (8, " ".join(texts[80][1].split()[25:60]))]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    index = D.build_index(docs)
    for window in (10, 3):
        got = D.search(index, bench, window=window).drop("n_near_items").collect()
        assert sorted(map(tuple, got)) == expected(texts, items, window)


def test_blocks_give_the_same(spark, docs, texts):
    bench = spark.createDataFrame(ITEMS + [(7, texts[10][1])], "item_id long, text string")
    got = D.search(D.build_index(docs), bench, window=4, block_bytes=40).drop("n_near_items").collect()
    assert sorted(map(tuple, got)) == expected(texts, ITEMS + [(7, texts[10][1])], 4)


def test_items_that_share_windows(spark, docs, texts):
    """Near copies as test items: each window of each of them counts for its own item."""
    items = [(k, t) for k, (_, t) in enumerate(texts[20:60])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    phrases = D.Phrases(items, 10)
    assert len(phrases.starts) == sum(max(1, len(terms(t)) - 9) for _, t in items if terms(t))
    got = D.search(D.build_index(docs), bench).drop("n_near_items").collect()
    assert sorted(map(tuple, got)) == expected(texts, items, 10)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x a b y c d e f"), (3, "f e d c b a")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "b c d e")], "item_id long, text string")
    found = {(r.doc_id, r.doc_start, r.kind) for r in D.matches(D.build_index(docs), bench).collect()}
    assert (1, 1, "phrase") in found and {d for d, _, k in found if k == "proximity"} == {2}
    assert {r.doc_id: r.n_near_items for r in D.search(D.build_index(docs), bench).collect()} == {1: 1, 2: 1, 3: 0}


def test_documents_go(spark, docs, none, texts):
    bench = spark.createDataFrame([(4, "Posted in this forum")], "item_id long, text string")
    kept = D.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(d for d, t in texts if not (t and "Posted in" in t))
    assert D.search(D.build_index(none), bench).count() == 0
    assert D.search(D.build_index(docs), bench.filter("false")).filter("contaminated").count() == 0
