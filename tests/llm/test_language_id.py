"""Languages that are rare, without letters, or in long texts only."""

import random

from framesift.llm import language_id

SCHEMA = "doc_id long, text string, lang string"


def maker(seed):
    """Texts of an invented language: words of its own syllables."""
    rng = random.Random(seed)
    syllables = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(2)) for _ in range(60)]
    return lambda n: " ".join(rng.choice(syllables) + rng.choice(syllables) for _ in range(n))


def right(spark, rows, asked):
    model = language_id.fit_language(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA))
    coder = language_id.Encoder(model)
    return sum(coder.predict(t)[0] == lang for t, lang in asked) / len(asked)


def test_rare_languages(spark):
    a, b = maker(1), maker(2)
    rows = [(f(120), lang) for _ in range(150) for f, lang in ((a, "aa"), (b, "bb"))]
    asked = [(f(40), lang) for _ in range(50) for f, lang in ((a, "aa"), (b, "bb"))]
    assert right(spark, rows, asked) == 1.0
    assert right(spark, [*rows, (maker(3)(4), "cc"), ("1 2 3", "dd")], asked) == 1.0


def test_long_texts_and_many_languages(spark):
    long = maker(4)
    makers = [maker(100 + i) for i in range(70)]
    rows = [(f(150), f"l{i}") for i, f in enumerate(makers) for _ in range(2)] + [(long(4000), "zz")]
    assert right(spark, rows, [(f(60), f"l{i}") for i, f in enumerate(makers)]) >= 0.95
    assert right(spark, rows, [(long(60), "zz") for _ in range(10)]) == 1.0


def test_no_language_is_passed_over():
    """Of more languages than SHORTLIST, the result is that of encoding for all, also where the grams mislead."""
    import numpy as np

    from framesift.llm.language_id import Encoder, LanguageModel

    rng = np.random.default_rng(3)
    words = [["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)] for _ in range(30)]
    model = LanguageModel(tuple((f"l{i:02}", tuple(" ".join(rng.choice(w, 300)).encode() for _ in range(2))) for i, w in enumerate(words)))
    coder, every = Encoder(model), Encoder(model)
    every.known = None
    coder.candidates = lambda raw: [0, 1, 2]  # as if these had most of the grams
    for i in (5, 17, 29):
        text = " ".join(rng.choice(words[i], 500))
        assert coder.predict(text) == every.predict(text) and coder.predict(text)[0] == f"l{i:02}"
