from conftest import LOWER, terms, words

import corpus_pipeline
from voxelry.llm import pack


def test_stages_against_brute_force(spark, docs, texts, tmp_path):
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    bench = [(1, "Posted in some book of words"), (2, texts[-5][1].split("the ")[0] or "x"), (3, " ".join(terms(texts[100][1])[:12]))]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, docs, str(tmp_path))
        if name == "packing":
            break
        assert frame.columns == docs.columns
        frame.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = sorted((r.doc_id, r.text) for r in docs.collect())
    # Texts with a letter stay.
    lettered = sorted((d, t) for d, t in texts if t and any(c.isalpha() for c in t))
    assert rows["language_id"] == lettered
    # The posts' footers go.
    assert [d for (d, a), (_, b) in zip(lettered, rows["line_dedup"], strict=True) if a != b] == list(range(80, 92))
    # One of each group stays.
    sets = {}
    for d, t in rows["line_dedup"]:
        w = words(t.translate(LOWER))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    ids, parent = sorted(sets), {d: d for d in sets}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = a, b
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)
    assert sorted({d for d, _ in rows["near_duplicates"]}) == [d for d in ids if parent[d] == d]
    # Documents with a passage of the benchmark go.
    known = {tuple(w[k : k + 10]) for _, t in bench for w in [terms(t)] for k in range(max(1, len(w) - 9)) if w}
    clean = [(d, t) for d, t in rows["near_duplicates"] if not any(tuple(w[k : k + len(g)]) == g for w in [terms(t)] for g in known for k in range(len(w)))]
    assert rows["benchmark_decontamination"] == clean and texts[100][0] not in {d for d, _ in clean}
    full = pack.encoder(pack.default_vocabulary()).full
    assert sum(r.length for r in frame.collect()) == sum(len(full.encode(t, add_special_tokens=False).ids) + 1 for _, t in clean)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == frame.count()


def test_no_documents(spark, none, tmp_path):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "any words of a test")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_and_columns(spark, docs, tmp_path):
    """Rows without an id, repeated rows, and columns whose names the stages use themselves."""
    odd = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "score", "key", "'x' as component_id", "1 as n", "array(1) as lines", "'y' as digest")
    lost = spark.createDataFrame([(None, "these words have no number", "en", "s", 26, 0, "k", "x", 1, [1], "y"), (None, None, None, None, None, None, None, "x", 1, [1], "y")], odd.schema)
    odd.union(lost).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nowhere in any of them is this to be found at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        if name == "packing":
            break
        assert out.columns == odd.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
    kept = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    assert (None, "these words have no number") in kept and sum(d == 160 for d, _ in kept) == 2
    assert out.filter("doc_id is null").agg({"length": "sum"}).first()[0] > 5
