import random

import pytest

SCHEMA = "doc_id bigint, text string, source string, lang string, n_chars bigint, size bigint, id string, n int, t int, v string, kept string, score string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def edited(rng, text, rate):
    return " ".join(sentence(rng, 1) if rng.random() < rate else w for w in text.split(" "))


def edge_rows():
    """Nulls, empty and long texts, copies, near copies, shared lines, repeated rows and ties."""
    rng = random.Random(42)
    base = [sentence(rng, 120) for _ in range(6)]
    shared = [sentence(rng, 30) for _ in range(3)]
    texts = [None, "", " \n\t", "one", "one two three four", *base, base[0], base[0], edited(rng, base[1], 0.01), edited(rng, base[1], 0.02), edited(rng, base[2], 0.03), edited(rng, base[2], 0.3)]
    texts += ["\n".join([sentence(rng, 20), s, sentence(rng, 12), shared[(i + 1) % 3], "end"]) for i, s in enumerate(shared * 3)]
    texts += [sentence(rng, 4000), "Straße 中文 naïve " * 40, "x" * 5000, "word " * 900, base[3].upper(), "a\n" * 60 + base[4]]
    rows = [(i, x, f"s{i % 4}" if i % 7 else None, "en", len(x or ""), 1, "q", 2, 3, "z", "k", "s") for i, x in enumerate(texts)]
    rows += [rows[8], rows[8], (None, base[5], None, None, None, None, None, None, None, None, None, None), (None, None, "s1", None, None, None, None, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
