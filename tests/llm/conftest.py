import random

import pytest

WORDS = [a + b for a in ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha") for b in ("", "at", "en", "es", "or", "ti", "ou", "ly")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "", ",", ".", ".\n")) for _ in range(n))


def changed(rng, text, share):
    words = text.split(" ")
    for _ in range(max(1, int(len(words) * share))):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
    return " ".join(words)


def corpus(seed=7, n=60):
    """(doc_id, text): prose, exact and near copies, shared passages, and the odd cases."""
    rng = random.Random(seed)
    passage = prose(rng, 70)
    texts = []
    for i in range(n):
        text = prose(rng, rng.randrange(30, 200))
        if i % 5 == 0:
            text += " " + passage + " " + prose(rng, 20)
        texts.append(text)
    texts += [texts[3]] * 5 + [changed(rng, texts[4], 0.02) for _ in range(6)] + [changed(rng, texts[i], 0.01) for i in range(5, 15)]
    texts += ["", "", None, None, " ", "\n\n", "a", "x" * 20_000, "ab " * 3_000, "ünï▁cödé 漢字 🙂 " * 30, "A B C", "a b c", "tab\tand\x0bnew\x0cline\r\n" * 20, "nul\x00byte " * 30]
    texts.append(prose(rng, 30_000))
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id bigint, text string").repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string, lang string")
