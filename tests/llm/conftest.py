import datetime
import random
import string

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality_note string"


@pytest.fixture(scope="session")
def corpus(spark):
    """Small corpus with nulls, empties, ties, repeated rows, near copies and a clashing column name."""
    r = random.Random(7)
    vocab = ["".join(r.choices(string.ascii_lowercase, k=r.randint(2, 8))) for _ in range(300)]
    texts = []
    for i in range(40):
        lines = [" ".join(r.choices(vocab, k=r.randint(3, 25))) for _ in range(r.randint(1, 8))]
        texts.append("\n".join(lines))
    for i in range(0, 12):
        words = texts[i].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [texts[0], texts[1], None, "", "  \n\t ", "one", "one two", "Released under the MIT License.", "mit license mit license apache license general public license", "naïve ☃ déjà vu <turn> \\", "a" * 5000, "a b c d e f g h i j " * 40]
    rows = [(i, t, "en", f"s{i % 5}" if i % 7 else None, len(t) if t is not None else None, "x") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5], None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
