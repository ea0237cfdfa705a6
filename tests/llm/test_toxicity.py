import math
import random
import re

import numpy as np

from stratum.llm import toxicity as T

CATEGORIES = {"rude": "rude", "toxic": "toxic"}


def corpus(n=900):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(5, 60))]
        rude, toxic = i % 4 == 0, i % 8 == 0
        words += ["Moron!"] * rude + [r.choice(["scum,", "TRASH"])] * toxic
        r.shuffle(words)
        docs.append((i, " ".join(words), "mine"))
        labels.append((i, int(rude), int(toxic)))
    return docs, labels


def test_held_out_accuracy():
    docs, labels = corpus()
    texts, y = [d[1] for d in docs], np.array([x[1:] for x in labels], float)
    model = T.fit(texts[:600], y[:600], list(CATEGORIES))
    p = T.predict(model, texts[600:])
    for k in range(2):
        assert ((p[:, k] >= model.thresholds[k]) == (y[600:, k] > 0)).mean() > 0.98
    assert len(model.weights[1]) == len(model.words) + 2  # the earlier category and the bias


def test_later_model_learns_from_out_of_fold_predictions():
    rng = np.random.default_rng(0)
    texts = [f"t{i} {'yes' if i % 3 == 0 else 'no'}" for i in range(600)]
    first = np.array([i % 3 == 0 for i in range(600)], float)
    noise = rng.random(600) < 0.1
    model = T.fit(texts, np.stack([first, np.where(noise, 1 - first, first)], axis=1), ["a", "b"])
    assert model.weights[1][-2] > 0


def test_spark_equals_local_and_defined_edges(spark):
    docs, labels = corpus(400)
    extra = [(5000, None, "x"), (5001, "", "x"), (None, "moron scum", "x"), (0, docs[0][1], "mine"), (5002, "word " * 50_000 + "scum moron", "x")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, p_toxic string")
    y = spark.createDataFrame(labels + [(None, 1, 1), (5000, None, 0)], "doc_id long, rude int, toxic int")
    model = T.train(d, y, CATEGORIES)
    got = T.score(d, model).collect()
    assert len(got) == len(docs) + len(extra)
    want = T.predict(model, [r.row.text for r in got])
    assert np.allclose([[r.p_rude, r.p_toxic] for r in got], want)
    flagged = {r.row.doc_id for r in got if r.is_toxic}
    assert {0, None, 5002} <= flagged and not flagged & {5000, 5001, 1, 2}
    again = T.train(d.repartition(5), y, CATEGORIES)
    assert again.words == model.words and np.allclose(np.concatenate(again.weights), np.concatenate(model.weights))


def test_no_labels_flags_nothing(spark):
    d = spark.createDataFrame([(1, "scum")], "doc_id long, text string")
    y = spark.createDataFrame([], "doc_id long, rude int, toxic int")
    assert [r.is_toxic for r in T.score(d, T.train(d, y, CATEGORIES)).collect()] == [False]
    assert T.score(d.limit(0), T.train(d, y, CATEGORIES)).count() == 0


def test_prediction_equals_the_chain_by_hand():
    docs, labels = corpus(500)
    model = T.fit([d[1] for d in docs], np.array([x[1:] for x in labels], float), list(CATEGORIES))
    texts = [d[1] for d in docs[:60]] + [None, "", "MORON, scum; trash", "moron moron"]
    for text, got in zip(texts, T.predict(model, texts)):
        words, before = set(re.findall(r"[a-z0-9]+", (text or "").lower())), []
        for k, row in enumerate(model.weights):
            z = sum(w for x, w in zip(model.words, row) if x in words) + sum(w * p for w, p in zip(row[len(model.words) : -1], before)) + row[-1]
            p = 1 / (1 + math.exp(-z))
            assert math.isclose(p, got[k], rel_tol=1e-9, abs_tol=1e-12)
            c = min(max(p, 1e-3), 1 - 1e-3)
            before.append(math.log(c / (1 - c)))


def test_an_id_that_repeats_counts_once_in_the_fit(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string, p_toxic string")
    more = d.unionByName(spark.createDataFrame([(3, f"other words {i} scum", "mine") for i in range(500)], d.schema))
    y = spark.createDataFrame(labels, "doc_id long, rude int, toxic int")
    a, b = T.train(d, y, CATEGORIES), T.train(more, y, CATEGORIES)
    assert len(a.words) > 0 and abs(len(a.words) - len(b.words)) <= 2
