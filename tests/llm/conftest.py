import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, words string, h int"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with clashing extra columns from (doc_id, text) pairs."""

    def table(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", None, 1) for i, t in rows], SCHEMA)

    return table


@pytest.fixture(scope="session")
def corpus():
    """Texts with nulls, empties, copies, near copies, shared passages and one long text."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgéß") for _ in range(r.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, line = prose(60), prose(6)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, prose(20000 // 8))]
    for k in range(10, 60):
        body = prose(r.randint(60, 160))
        rows.append((k, f"{line}\n{body}\n{passage}\n{prose(30)}" if k % 3 == 0 else body))
    copies = [(100 + k, t) for k, (i, t) in enumerate(rows[10:20])]
    near = [(200 + k, " ".join(t.split(" ")[:-1] + ["changed"])) for k, (i, t) in enumerate(rows[20:30])]
    return rows + copies + near + [(60, "x" * 300), (61, "x" * 250)]
