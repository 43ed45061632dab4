import math
import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import langid, quality_gbt

SYLLABLES = {"xx": "ba do ku mi".split(), "yy": "tré sça über".split(), "zz": "shr mng pfl".split()}


def sentence(r, lang, n):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    r = random.Random(8)
    rows = [(i, sentence(r, lang := r.choice("xx yy zz".split()), r.choice([5, 60, 900])), lang, i) for i in range(240)]
    rows += [(900, None, "xx", 1), (901, "", "yy", 1), (902, "12 -- 34", "zz", 1), (903, "ba do", None, 1), (903, "ba do", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").repartition(3)


def test_language_of_held_out_documents(documents):
    net = langid.train(documents, per_label=60)
    assert net.labels == ["xx", "yy", "zz"]
    got = langid.identify(documents, net).collect()
    assert len(got) == 245 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["doc_id"] < 900]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if 900 <= r["doc_id"] < 903} == {k: ("und", 0.0) for k in (900, 901, 902)}
    again = langid.train(documents.repartition(5), per_label=60)
    assert all(np.array_equal(net.p[k], again.p[k]) for k in net.p)


def test_rows_without_language_go_and_null_langs_are_filled(documents):
    net = langid.train(documents, per_label=30)
    got = langid.keep_identified(documents, net)
    assert got.columns == documents.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert not {900, 901, 902} & set(rows) and rows[903]["lang"] == "xx" and got.filter("doc_id = 903").count() == 2


def test_nothing_to_learn_languages_from(spark):
    none = spark.createDataFrame([(1, "abc", None), (2, None, "xx")], "doc_id long, text string, lang string")
    net = langid.train(none)
    assert {r["lang_pred"] for r in langid.identify(none, net).collect()} == {"und"}
    assert langid.identify(none.limit(0), net).count() == 0


def test_every_window_counts():
    net = langid.ByteCNN(["a", "b"], length=16)
    x = net.windows("é" * 20)
    assert x.shape == (3, 16) and x.reshape(-1)[:40].tobytes() == ("é" * 20).encode()
    assert net.predict(["ab" * 5000, "x"]) == [net.predict(["ab" * 5000])[0], net.predict(["x"])[0]]


def test_gradients_of_the_network():
    net = langid.ByteCNN(["a", "b", "c"], length=12, dim=3, filters=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 120, (5, 12)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    loss = lambda: -net.forward(x)[2][1][np.arange(5), y].mean()
    before = {k: v.copy() for k, v in net.p.items()}
    start = loss()
    net.fit(x, y, epochs=30, batch=5, rate=1e-2)
    assert loss() < 0.5 * start and any(not np.array_equal(before[k], net.p[k]) for k in before)


def test_forward_pass_is_that_of_plain_loops():
    net = langid.ByteCNN(["a", "b", "c"], length=11, dim=3, filters=2, seed=4)
    rng = np.random.default_rng(2)
    net.p |= {k: rng.normal(0, 0.5, net.p[k].shape).astype(np.float32) for k in ("bias", "top", "out")}
    x = rng.integers(0, 256, (6, 11)).astype(np.uint8)
    for row, logp in zip(x, net.forward(x)[2][1], strict=True):
        pooled = []
        for i, width in enumerate(langid.WIDTHS):
            for f in range(2):
                sums = []
                for at in range(11):
                    context = [row[at + k] if at + k < 11 else 0 for k in range(width)]
                    sums.append(sum(float(net.p["emb"][b][d]) * float(net.p["conv"][k * 3 + d][i * 2 + f]) for k, b in enumerate(context) for d in range(3)))
                pooled.append(max(0.0, max(sums) + float(net.p["bias"][i * 2 + f])))
        z = [sum(p * float(w) for p, w in zip(pooled, net.p["out"][:, c], strict=True)) + float(net.p["top"][c]) for c in range(3)]
        assert logp == pytest.approx([v - math.log(sum(map(math.exp, z))) for v in z], abs=1e-5)


@pytest.mark.parametrize("text", ["½", "²", "Ⅷ", "12 -- 34", "١٢", "", None, "①"])
def test_what_is_no_letter(text):
    net = langid.ByteCNN(["a", "b"], length=8)
    assert net.predict([text]) == [("und", 0.0)] and net.predict([(text or "") + "é"])[0][0] in "ab"


def test_null_ids_are_not_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "ba do ku", "xx"), (1, "tré sça", "yy"), (4, "½", None)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for query, modulus, left in ((langid.op10_language_id, 3, 1), (quality_gbt.op3_quality, 4, 2)):
        assert {r["doc_id"]: r["held_out"] for r in query(spark, str(tmp_path)).collect()} == {None: False, **{k: crc32(str(k).encode()) % modulus == left for k in (1, 4)}}


def test_low_scores_are_rejected(documents):
    net = langid.train(documents, per_label=30)
    every = langid.keep_identified(documents, net, least=0.0).count()
    assert langid.keep_identified(documents, net).count() == every == 242 and langid.keep_identified(documents, net, least=1.01).count() == 0


def test_splits_are_those_of_a_plain_search():
    """Trees grown by trying every cut of every feature on the rows of every node, one after another."""
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(150, 3)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gbt.HistogramGBT(trees=4, depth=2, bins=8, min_rows=5).fit(x, y)
    cuts = [sorted({float(np.quantile(x[:, j], k / 8)) for k in range(1, 8)}) for j in range(3)]
    margin = [model.base] * len(y)
    for _ in range(model.trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad, hess = [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p]
        score = lambda rows: sum(grad[i] for i in rows) ** 2 / (sum(hess[i] for i in rows) + model.ridge)  # noqa: B023, E731
        leaves = [list(range(len(y)))]
        for _ in range(model.depth):
            grown = []
            for rows in leaves:
                best = (1e-9, rows, [])
                for j in range(3):
                    for cut in cuts[j]:
                        left, right = [i for i in rows if x[i, j] <= cut], [i for i in rows if x[i, j] > cut]
                        if min(len(left), len(right)) >= model.min_rows and (gain := score(left) + score(right) - score(rows)) > best[0] + 1e-9:
                            best = (gain, left, right)
                grown += best[1:]
            leaves = grown
        for rows in leaves:
            for i in rows:
                margin[i] += model.rate * sum(grad[k] for k in rows) / (sum(hess[k] for k in rows) + model.ridge)
    assert model.score(x) == pytest.approx([1 / (1 + math.exp(-m)) for m in margin], abs=1e-9)


def test_trees_fit_and_flat_walk_is_that_of_single_rows():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = quality_gbt.HistogramGBT(trees=40, depth=3).fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        total = model.base
        for t in range(model.trees):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.threshold[t, node])
            total += model.value[t, node - (2**model.depth - 1)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:40]], model.score(x[:40]))
    assert quality_gbt.HistogramGBT().fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert quality_gbt.HistogramGBT().fit(x, np.ones(600)).score(x).min() > 0.9


def test_quality_of_held_out_documents(spark):
    r = random.Random(3)
    good = lambda: " ".join(sentence(r, "xx", 9).capitalize() + "." for _ in range(r.randint(1, 30)))
    bad = lambda: " ".join(w + r.choice(["###", "$$$"]) for w in sentence(r, "xx", r.randint(3, 200)).split())
    docs = [(i, good() if i % 3 else bad(), "s") for i in range(300)] + [(900, None, "s"), (901, "", "s"), (901, "", "s")]
    labels = [(i, int(i % 3 > 0), "s") for i in range(0, 300)] + [(5, None, "s"), (777, 1, "s")]
    documents, table = spark.createDataFrame(docs, "doc_id long, text string, quality string"), spark.createDataFrame(labels, "doc_id long, quality int, text string")
    model = quality_gbt.train(documents, table)
    got = quality_gbt.classify(documents, model).withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    assert len(got) == 303 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in got)
    assert all(x["predicted"] == int(x["doc_id"] % 3 > 0) for x in got if x["held"] and x["doc_id"] < 300)
    assert quality_gbt.train(documents.repartition(7), table).score(np.zeros((1, len(quality_gbt.FEATURES)))) == model.score(np.zeros((1, len(quality_gbt.FEATURES))))
    assert quality_gbt.classify(documents.limit(0), model).count() == 0
    assert quality_gbt.statistics(None) == quality_gbt.statistics("") and len(quality_gbt.statistics("a b")) == len(quality_gbt.FEATURES)
