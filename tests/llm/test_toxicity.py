import math

import numpy as np
from pyspark.sql import functions as F

from kairoline.llm import toxicity


def corpus(n=240):
    calm = ["the sun is warm today", "a quiet river runs by", "we walk home at night", "bread and tea for two"]
    texts, labels = [], []
    for i in range(n):
        own = [f"{calm[(i + k) % 4]} {chr(97 + i % 26)}{k}" for k in range(5)]
        bad = i % 3 == 0
        if bad:
            own[i % 5] = f"{calm[i % 4]} you {('grubbish', 'vilemouth', 'nastyface')[i % 9 // 3]}"
        texts.append(". ".join(own) + ".")
        labels.append(int(bad))
    return texts, labels


def test_held_out_documents_and_sentences():
    texts, labels = corpus()
    model = toxicity.calibrated(texts[:180], labels[:180])
    right = [(model.document(t) >= 0.7) == bool(y) for t, y in zip(texts[180:], labels[180:], strict=True)]
    assert sum(right) / len(right) > 0.95
    worst = max(model.sentences(texts[180]), key=lambda s: s[2])
    assert labels[180] == 1 and "you" in texts[180][worst[0] : worst[1]]


def test_document_is_the_noisy_or_of_its_sentences():
    model = toxicity.Model({"bad": 3.0, "bad*": 1.0}, -1.0)
    text = "Bad thing. Fine thing!\nbadly"
    p = 1.0
    for _, _, s in model.sentences(text):
        p *= 1 - s
    assert abs(model.document(text) - (1 - p)) < 1e-9
    assert model.document(None) == model.document("") == model.document(" .. ") == 0.0


def test_scores_of_a_fitted_model_are_the_noisy_or_too():
    texts, labels = corpus()
    model = toxicity.calibrated(texts, labels)
    assert model.bias != toxicity.train(texts, labels).bias
    for t in texts[:60]:
        p = 1.0
        for _, _, s in model.sentences(t):
            p *= 1 - s
        assert abs(model.document(t) - (1 - p)) < 1e-9


def test_training_follows_the_gradient_of_the_documents_loss():
    """The trained weights against a plain descent, by differences, of the same loss."""
    texts, labels = ["good day. bad egg", "good egg", "fine day. good", "bad day", "good good. egg", "bad. fine"] * 4, [1, 0, 0, 1, 0, 1] * 4
    model = toxicity.train(texts, labels)

    def loss(weights, bias):
        total = 0.0
        for t, y in zip(texts, labels, strict=True):
            q = 1.0
            for a, b in toxicity.sentence_spans(t):
                z = bias + sum(weights.get(f, 0.0) for w in set(t[a:b].split()) for f in toxicity.features(w))
                q *= 1 - 1 / (1 + math.exp(-z))
            total -= (math.log(max(1 - q, 1e-12)) / labels.count(1) if y else math.log(max(q, 1e-12)) / labels.count(0)) / 2
        return total

    own = loss(model.weights, model.bias)
    assert own < 0.02 and model.weights["bad"] > 0 > model.weights["good"]
    # no step in any one weight makes it much better
    for f in [*model.weights, None]:
        for step in (-0.3, 0.3):
            moved = {**model.weights, **({f: model.weights[f] + step} if f else {})}
            assert loss(moved, model.bias + (0 if f else step)) > own - 0.01


def test_room_is_where_the_threshold_is_met():
    rng = np.random.default_rng(1)
    docs = [rng.normal(size=n) * 5 for n in (1, 3, 40)] + [np.zeros(0)]
    room = toxicity._room(docs, 0.7)
    for z, r in zip(docs[:3], room, strict=False):
        assert abs(1 - np.prod(1 - 1 / (1 + np.exp(-(z - r)))) - 0.7) < 1e-9
    assert room[3] < -59


def test_one_class_or_nothing():
    assert toxicity.train(["a", "b"], [1, 1]).document("x") > 0.99 and toxicity.train(["a"], [0]).document("x") < 0.01 and toxicity.train([], []).document("x") < 0.01


def test_tables(spark, odd, empty):
    texts, labels = corpus(90)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(None, "a b", "s"), (500, None, "s"), (501, "", "s")], "doc_id long, text string, score string")
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(None, 1), (500, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    assert toxicity.fit(docs.repartition(7), marks).weights == model.weights
    got = toxicity.score(docs, model)
    assert got.count() == docs.count() and got.where("doc_id IN (500, 501) AND (score <> 0 OR predicted <> 0)").count() == 0
    assert got.where("score < 0 OR score > 1").count() == 0
    assert got.where("predicted = 1 AND size(offending) = 0").count() == 0 and got.where("predicted = 1").count() > 20
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(empty, model).count() == 0
    assert toxicity.fit(empty, marks).weights == {} and toxicity.score(docs, toxicity.fit(docs, marks.where("false"))).agg(F.max("score")).first()[0] < 0.01


def test_every_offending_sentence_is_reported(spark):
    model = toxicity.Model({"bad": 3.0, "poor": 1.2}, -1.0)
    many = ". ".join(["a bad thing", "a fine thing"] * 10) + "."
    weak = "a poor thing. a plain thing. a poor poor thing. a poor one"
    docs = spark.createDataFrame([(1, many), (2, weak), (3, "a fine thing. another"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert [many[s.start : s.end].strip() for s in got[1].offending] == ["a bad thing"] * 10
    assert [s.start for s in got[1].offending] == sorted(s.start for s in got[1].offending)
    # flagged by all its sentences together, none of which reaches the threshold
    assert got[2].predicted == 1 and max(p for _, _, p in model.sentences(weak)) < 0.7
    assert [weak[s.start : s.end] for s in got[2].offending] == ["a poor thing"]
    assert got[3].predicted == got[4].predicted == 0 and got[3].offending == got[4].offending == []
    assert len(toxicity.score(docs, model, located=3).where("doc_id = 1").first().offending) == 3
