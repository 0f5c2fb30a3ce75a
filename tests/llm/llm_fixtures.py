import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, row long"


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho".split()) + str(rng.randrange(40)) for _ in range(n))


def document_rows():
    """Copies, near copies, a chain of near copies, shared passages, and odd rows."""
    rng, rows, texts = random.Random(5), [], []
    bases = [sentence(rng, rng.randrange(40, 160)) for _ in range(25)]
    passage = sentence(rng, 60)
    for base in bases:
        texts.append(base)
        for _ in range(rng.randrange(4)):
            words = base.split()
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = "edit" + str(rng.randrange(1000))
            texts.append(" ".join(words))
    texts += [base.upper() for base in bases[:3]] + bases[3:6] * 3
    texts += [passage + " " + sentence(rng, rng.randrange(5, 60)) for _ in range(12)]
    drift = bases[0].split()
    for k in range(8):
        drift = drift[:]
        drift[(k * 13) % len(drift)] = f"drift{k}"
        texts.append(" ".join(drift))
    texts += [None, None, "", "  \n\t ", "one two", "One  TWO", "a b c d", "été " * 30, sentence(rng, 6000),
              "x" * 5000, "same line\nsame line\n\nsame line\nother", "# $ % & | < > *", "日本語 \U0001f642 text"]
    for i, text in enumerate(texts):
        rows.append((i * 3 + 1, text, "en", "src0", len(text or ""), 0.5, i))
    rows += [(None, bases[1], None, None, None, None, None), (None, None, None, None, None, None, None)]
    rows += [rows[4], rows[4]]
    return rows


@pytest.fixture(scope="session")
def document_list():
    return document_rows()


@pytest.fixture(scope="session")
def odd_documents(spark, document_list):
    return spark.createDataFrame(document_list, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], COLUMNS)
