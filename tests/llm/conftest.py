import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Rows of a small corpus: prose, exact and near copies, shared lines and passages, and every odd case."""
    rng = random.Random(5)
    words = ["".join(rng.choice(["an", "co", "de", "fi", "ha", "in", "to", "the", "é", "ß"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    passage = prose(40)
    texts = [None, "", "   \n\t ", "one", "two words", "!!! ...", "A\x00b 日本語 🙂\n\nend", "Same", "Same", "x" * 5000, "ab " * 900]
    for _ in range(60):
        t = "\n".join(prose(rng.randint(5, 60)) for _ in range(rng.randint(1, 5)))
        if rng.random() < 0.4:
            t += "\n" + passage
        if rng.random() < 0.5:
            t = "A line that stands on many sites.\n" + t
        texts.append(t)
        for _ in range(rng.choice([0, 0, 1, 3])):
            near = t.split(" ")
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(near))
    rows = [(i * 3, t, "en", f"s{i % 7}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[-1], (None, "No identifier here at all.", None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The corpus with columns named like what the operators use inside."""
    from pyspark.sql import functions as F

    names = ("pos", "len", "item_id", "window", "n", "key", "bucket", "digest", "text_hash", "__text", "__row", "node", "root", "score", "kept", "label")
    return docs.select("*", *[F.lit(n).alias(n) for n in names])
