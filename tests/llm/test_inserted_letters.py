import pytest

from symgraph.llm import toxicity as X

WORDS = ["idxixot", "ixdixot", "ixdxixoxt", "mxorxon", "stxupxid", "scxumxbag", "iqqdqqiwwozzt", "pxatxhexticx"]


def test_kernel_sees_several_inserted_letters():
    landmarks = ["idiot", "moron", "stupid", "scumbag", "pathetic"]
    value = X.Kernel(landmarks).of(WORDS)
    own = ["idiot", "idiot", "idiot", "moron", "stupid", "scumbag", "idiot", "pathetic"]
    assert all(value[i, landmarks.index(w)] > 0.3 for i, w in enumerate(own))
    assert X.letters_only("you i d i o t, be") == ["you", "idiot", "be"]


@pytest.mark.parametrize(("landmark", "word", "span"), [("idiot", "xxidiotxx", 5), ("idiot", "ixdxixoxt", 9), ("idiot", "iiiidiot", 5), ("idiot", "toidi", 0), ("ab", "a" * 200_000 + "b", 2)])
def test_span_is_the_tightest(landmark, word, span):
    assert X._span(landmark, word) == span


def test_insults_of_five_to_eight_letters_with_insertions_are_scored_toxic(spark):
    bad = ["you idiot", "you moron", "you stupid", "you scumbag", "you pathetic"]
    labelled = spark.createDataFrame([(i, bad[i // 4 % 5] if i % 4 == 0 else f"calm words of day {i}", int(i % 4 == 0)) for i in range(400)], "id long, text string, label int")
    model = X.train(labelled)
    texts = [*(f"calm {w} words" for w in WORDS), "calm i d i o t words", "calm words", "calm day of words"]
    got = [r.toxicity for r in X.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), model).orderBy("id").collect()]
    assert min(got[:-2]) >= 0.7 and max(got[-2:]) < 0.5, got
