import random

import pytest

EXTRA = ["key", "row", "body", "component_id", "tokens", "bucket", "copy", "number", "found", "p", "rate", "copies", "rep", "shard",
         "n_shingles", "task", "a", "b", "lang_pred", "score", "piece", "length", "place", "words", "host", "n", "bad", "turn"]


def sentence(rng, n):
    return " ".join(rng.choice("the of and to in is that for with as on by are this be it an from at was".split()) + rng.choice(["", "a", "er", "ing"])
                    for _ in range(n))


@pytest.fixture(scope="session")
def hard_texts():
    """(doc_id, text): NULLs, empty, blank, one word, very long, ties, repeated rows."""
    rng = random.Random(5)
    base = sentence(rng, 400)
    words = base.split()
    near = " ".join(words[:200] + ["changed"] + words[201:])
    long = sentence(rng, 60_000)
    return [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, "word"), (7, "word"), (8, "Word"), (9, "two words"),
        (10, long), (11, "É ñ 漢字 👍🏽 \x1c \x85\xa0x"), (None, base), (None, None), (12, "a b c"), (13, "A B C"),
        (14, "\n".join(["same line here again"] * 40)), (15, sentence(rng, 30)), (16, base.upper()), (20, "12 34 5.5"),
    ]


@pytest.fixture(scope="session")
def hard(spark, hard_texts):
    """The hard texts among columns whose names operators use inside."""
    rows = [(*r, *[None if i % 3 == 0 else i] * len(EXTRA)) for i, r in enumerate(hard_texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in EXTRA)).repartition(3).cache()


@pytest.fixture(scope="session")
def none(hard):
    return hard.where("false")
