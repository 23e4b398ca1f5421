"""The classifier finds toxic texts with no labels, and with few that a sample of all texts would miss."""

import random

import pytest

from tidewatch.llm import quality_classifier

INSULTS = ("you are a stupid idiot", "pathetic loser", "what worthless scum", "you moron")


def text(k):
    """Invented prose; every tenth text holds an insult."""
    rng = random.Random(k)
    w = [rng.choice("abcdefg") + rng.choice("hijkl") + rng.choice("mnopqr") + rng.choice("aeiou") for _ in range(60)]
    return " ".join([*w[:30], *(INSULTS[k // 10 % 4].split() if k % 10 == 0 else []), *w[30:]])


@pytest.mark.parametrize("labelled", [0, 6])
def test_toxic_texts_go_with_few_labels(spark, labelled):
    rows = [(k, text(k)) for k in range(3500)]
    train = spark.createDataFrame(rows[:3000], "doc_id long, text string")
    few = [*range(0, 30, 10), *range(1, 4)] if labelled else []
    labels = spark.createDataFrame([(k, 1, int(k % 10 == 0)) for k in few], "doc_id long, quality int, toxic int") if labelled else None
    scorer = quality_classifier.fit(train, labels, sample=2000)
    got = {r.id: r.toxicity for r in quality_classifier.classify(spark.createDataFrame(rows[3000:], "doc_id long, text string"), scorer).collect()}
    assert all((x >= quality_classifier.TOXIC) == (k % 10 == 0) for k, x in got.items())


def test_annotators_are_believed_as_far_as_votes_bear_them_out(spark):
    """Annotators who answer at random don't change what is found; labels of one text in five are withheld and measure."""
    rows = [(k, text(k)) for k in range(3500)]
    rng = random.Random(9)
    labels = spark.createDataFrame([(k, 1, int(rng.random() < 0.5)) for k in range(0, 3000, 5)], "doc_id long, quality int, toxic int")
    scorer = quality_classifier.fit(spark.createDataFrame(rows[:3000], "doc_id long, text string"), labels, sample=2000)
    got = {r.id: r.toxicity for r in quality_classifier.classify(spark.createDataFrame(rows[3000:], "doc_id long, text string"), scorer).collect()}
    assert sum((x >= quality_classifier.TOXIC) == (k % 10 == 0) for k, x in got.items()) >= 0.98 * len(got)
    agree, n = scorer.measured["lexicon/toxicity"]
    assert 30 <= n <= 90 and 0.25 < agree / n < 0.75 and "annotator/toxicity" not in scorer.measured
    assert scorer.accuracies["annotator/toxicity"] < 0.75 < scorer.accuracies["lexicon/toxicity"]
