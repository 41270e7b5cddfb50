import random

import pytest

VOCAB = [a + b for a in ("th", "er", "on", "qu", "st", "ba", "lo") for b in ("a", "in", "ent", "o", "us", "ir")]


@pytest.fixture(scope="session")
def rng():
    return random.Random(11)


def sentence(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="session")
def texts(rng):
    """doc_id -> text: originals, exact and near copies, shared passages, empty, null and long texts."""
    passage = sentence(rng, 60)
    out = {i: sentence(rng, rng.randint(1, 120)) + "\n" + sentence(rng, 12) for i in range(40)}
    for i in range(40, 60):  # near copies of one text
        words = out[0].split(" ")
        words[rng.randrange(len(words))] = "changed%d" % i
        out[i] = " ".join(words)
    for i in range(60, 66):
        out[i] = out[i - 60]
    for i in range(66, 72):
        out[i] = sentence(rng, 20) + " " + passage + " " + sentence(rng, 15)
    out[72], out[73], out[74], out[75] = "", None, "   \n\t ", "a" * 1200
    out[76] = sentence(rng, 9000) + " çà et là ünïcode"
    out[77] = "one two"
    out[78] = "ONE  two"
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With further columns whose names the operators use inside, and one repeated row."""
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or ""), "x", "y", 1) for i, t in texts.items()]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, size string, n int").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
