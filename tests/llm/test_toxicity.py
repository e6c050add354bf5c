import random

import numpy as np

from tiergraph.llm import toxicity as X


def data(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(600)}" for _ in range(rng.randrange(20, 80))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["Vile", "NASTY!", "awful"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy_and_whole_texts(spark):
    rows = data(900)
    docs = spark.createDataFrame([(i, t, 9.0, 1) for i, t, _ in rows], "doc_id long, text string, score double, label int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 600], "doc_id long, toxic int")
    model = X.fit(docs, labels, l1=4.0)
    assert model == X.fit(docs, labels, l1=4.0)
    got = {r.doc_id: r.score for r in X.score(docs, model).collect()}
    right = [(got[i] >= 0.3) == bool(y) for i, _, y in rows if i >= 600]
    assert sum(right) / len(right) > 0.95
    assert len(model[1]) < 400  # sparse
    late = spark.createDataFrame([(1, "w1 " * 60_000), (2, "w1 " * 60_000 + "vile nasty awful")], "doc_id long, text string")
    a, b = (r.score for r in X.score(late, model).orderBy("doc_id").collect())
    assert b > a + 0.3


def test_nulls_empties_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "y"), (3, "y")], "doc_id long, text string")
    none = X.fit(docs, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))
    scores = [r.score for r in X.score(docs, none).collect()]
    assert scores == [0.5] * 5
    some = X.fit(docs, spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 1)], "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 for r in X.score(docs, some).collect())
    assert X.score(docs.limit(0), some).count() == 0


def test_ftrl_drops_what_does_not_tell():
    rng = np.random.default_rng(0)
    rows = [(np.unique(np.append(rng.integers(100, 5000, 30), 7 if y else 8)), int(y)) for y in rng.random(600) < 0.5]
    _, weights = X.train_ftrl(rows, l1=8.0)
    assert weights[7] > 1 and weights.get(8, 0) < weights[7] and len(weights) < 1500


def test_learning_and_scores_equal_brute_force(spark):
    """The stream learns what a plain loop over the same rows learns; a score is the logistic of the weights of a text's features."""
    from pyspark.sql import functions as F

    rows = data(120, seed=5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(3, "zz other text"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(2, 1 - rows[2][2]), (777, 1)], "doc_id long, toxic int")
    model = X.fit(docs, labels, l1=0.5, epochs=3)
    texts = {i: t for i, t, _ in rows}
    texts[3] = min(texts[3], "zz other text")
    known = [(i, y) for i, _, y in rows] + [(2, 1 - rows[2][2])]
    turns = spark.createDataFrame([(e, i, y) for e in (1, 2, 3) for i, y in known], "epoch int, id long, label int").withColumn("turn", F.xxhash64(F.lit(7), "epoch", F.col("id").cast("string"), "label"))
    state = X.Ftrl(l1=0.5)
    for r in turns.orderBy("epoch", "turn", "id", "label").collect():
        state.learn(np.unique(X.features(texts[r.id], X._Tokens())), r.label)
    bias, weights = state.weights()
    assert abs(model[0] - bias) < 1e-12 and model[1].keys() == weights.keys() and all(abs(model[1][p] - w) < 1e-9 for p, w in weights.items())
    for r, (i, t) in zip(X.score(docs, model).collect(), [(i, t) for i, t, _ in rows] + [(3, "zz other text"), (4, None)], strict=True):
        total = bias + sum(weights.get(int(p), 0.0) for p in set(X.features(t, X._Tokens()).tolist()))
        assert r.doc_id == i and abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9
