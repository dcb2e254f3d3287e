import random

import numpy as np
from conftest import SPACE

from voxelry.llm import language as G
from voxelry.llm import quality as Q


def made(spark, n=240):
    r = random.Random(1)
    parts = {"en": "the of and thing ound er ing tion".split(), "de": "der und sch keit ein ung über pf".split(), "fr": "le éa que eau tion oux des è".split()}
    rows = []
    for k in range(n):
        lang = ("en", "de", "fr")[k % 3]
        text = " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 60)))
        if k % 5 == 4:
            text = " ".join(x + r.choice("#$%&") * 3 for x in text.upper().split())
        rows.append((k, text, lang, int(k % 5 != 4)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")


def test_held_out_languages(spark, none):
    docs = made(spark)
    model = G.train(docs.filter(~G.held_out()))
    got = G.predict(docs, model).join(docs.select("doc_id", "lang", G.held_out().alias("out")), "doc_id").filter("out").collect()
    assert len(got) > 40 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ... 34"), (4, "der und keit"), (4, "der und keit"), (5, "zzz"), (None, "the thing and of")], "doc_id long, text string")
    by = {r.doc_id: r for r in G.predict(odd, model).collect()}
    assert [by[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and [by[k].score for k in (1, 2, 3)] == [0] * 3
    assert by[4].lang_pred == "de" and by[5].lang_pred in {"en", "de", "fr"} and by[None].lang_pred == "en"
    assert G.accepted(odd, model).count() == 4 and G.accepted(odd, model).columns == odd.columns
    untaught = G.train(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in G.predict(odd, untaught).collect()} == {"und"} and G.accepted(odd, untaught).count() == 4
    assert G.predict(none, model).count() == 0 and G.train(none).languages == []


def test_scores_against_brute_force(spark, docs, texts):
    """Scores by the definition, word by word, from the model's own tables."""
    import math

    model = G.train(docs, words=60, grams=80)
    names = model.languages
    words, grams = {}, {}
    for units, out, keys in ((model.words, words, model.words.keys.to_pylist()), (model.grams, grams, model.grams.keys.tolist())):
        for u, key in enumerate(keys):
            at, _ = units.entries(np.array([u]))
            out[key] = {int(units.language[k]): float(units.score[k]) for k in at}

    def code(g):
        return int(G._gram_codes(np.frombuffer(g.encode("utf-32-le"), np.uint32), len(g))[0])

    def word_scores(w):
        if w in words:
            return [model.words.floor[k] + words[w].get(k, 0) for k in range(len(names))], [float(k in words[w]) for k in range(len(names))]
        padded, at, parts, total, cover = f"^{w}$", 0, 0, [0.0] * len(names), [0.0] * len(names)
        while at < len(padded):
            n = next((n for n in range(min(4, len(padded) - at), 0, -1) if code(padded[at : at + n]) in grams), 1)
            own = grams.get(code(padded[at : at + n]), {})
            for k in range(len(names)):
                total[k] += model.grams.floor[k] + own.get(k, 0)
                cover[k] += n / len(padded) if n >= 3 and k in own else 0
            at, parts = at + n, parts + 1
        return [x / parts for x in total], cover

    got = sorted((r.doc_id, r.lang_pred, round(r.score, 6)) for r in G.predict(docs, model).collect())
    want = []
    for d, t in texts:
        own = ["".join(c for c in w.lower() if c.isalpha()) for w in SPACE.findall(t or "")]
        own = [w for w in own if w]
        if not own:
            want.append((d, "und", 0.0))
            continue
        z = [sum(word_scores(w)[0][k] for w in own) + model.priors[k] for k in range(len(names))]
        z = [(x - max(z)) / math.sqrt(len(own)) for x in z]
        p = [math.exp(x) / sum(map(math.exp, z)) for x in z]
        want.append((d, names[p.index(max(p))], round(max(p), 6)))
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert all(abs(x[2] - y[2]) < 1e-5 for x, y in zip(got, sorted(want), strict=True))


def test_every_label_is_learnt(spark):
    r = random.Random(3)
    rows = []
    for k in range(90):
        own = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)]
        rows += [(4 * k + i, " ".join(r.choice(own) for _ in range(30)), f"l{k:02}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = G.train(docs)
    assert len(model.languages) == 90
    got = G.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(x.lang == x.lang_pred for x in got)


def test_unlearnt_languages_and_junk_are_rejected(spark):
    docs = made(spark)
    model = G.train(docs)
    r = random.Random(2)
    other = " ".join("".join(r.choice(["qwx", "zzk", "vrxq", "kjw"]) for _ in range(2)) for _ in range(60))
    junk = " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(60))
    odd = spark.createDataFrame([(1, other), (2, junk), (3, "привет как дела " * 20), (4, "der und keit sch")], "doc_id long, text string")
    assert [x.doc_id for x in G.accepted(odd, model).collect()] == [4]
    assert G.accepted(docs, model).count() == docs.count()


def test_held_out_quality(spark, none):
    docs = made(spark)
    labels = docs.select("doc_id", "quality")
    seen = ~G.held_out()
    model = Q.train(docs.filter(seen), labels.filter(seen))
    got = Q.score(docs, model).join(labels, "doc_id").filter(G.held_out()).collect()
    right = sum((r.score >= 0.5) == (r.quality == 1) for r in got)
    assert right >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    alone = Q.train(docs.filter(seen), labels.filter(seen).filter("quality = 1"))
    assert 0.5 < alone.prior < 0.99
    # Labels of bad documents play no part: the same model without them.
    assert alone.prior == model.prior and np.allclose(alone.weights, model.weights)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 10000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in Q.score(odd, model).collect())
    assert Q.train(docs, labels.filter("false")) is None and {r.score for r in Q.score(odd, None).collect()} == {0.5}
    assert Q.score(none, model).count() == 0


def test_features_are_finite(texts):
    import pyarrow as pa

    from voxelry.llm import words as W

    for c in W.chunks(pa.array([t for _, t in texts], pa.string())):
        x = Q.features(c)
        assert x.shape[1] == Q.N_FEATURES and np.isfinite(x).all()
