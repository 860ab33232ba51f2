import random

import pytest

#: Columns that clash with names the operators use themselves.
CLASHING = ["at", "digest", "key", "n", "class", "kept", "piece", "length", "window", "hits", "bands"]


@pytest.fixture(scope="session")
def table(spark):
    """A documents table of (doc_id, text) pairs, with clashing columns."""

    def build(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame([(i, t, "en" if i else None, None, len(t or ""), *["x"] * len(CLASHING)) for i, t in rows], schema)

    return build


@pytest.fixture(scope="session")
def words():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 8))) for _ in range(400)]
    return lambda n, seed: [random.Random(seed * 7919 + k).choice(vocabulary) for k in range(n)]


@pytest.fixture(scope="session")
def rows(words):
    """Nulls, empty and blank texts, copies, repeated rows, near copies, a long text."""
    base = words(300, 1)
    near = base.copy()
    near[150] = "changed"
    passage = " ".join(words(120, 2))
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "one two three"), (6, " ".join(base)), (7, " ".join(near)), (7, " ".join(near)), (8, " ".join(base)), (9, "x " + passage + " y"), (10, passage.upper() + " " + passage), (11, "long " * 3000 + "a" * 20_000), (12, "and Ab-1 " * 90), (13, "12 3.4 don't they'll <|endoftext|> é中文 🎉"), (None, "without an id")]
    return out + [(100 + k, " ".join(words(60 + k, 50 + k))) for k in range(12)]
