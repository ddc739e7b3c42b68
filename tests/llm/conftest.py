import random

import pytest

#: Names that operators use inside; a table may have them too.
CLASHING = "id string, n string, file string, row string, mark string, kept string, root string, digest string, body string, spans string, path string, host string, label string, gone_id string, alone string"


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls, blanks, ties, repeated rows, a very long text, near copies, few words."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    base = " ".join(rng.choice(words) for _ in range(120))
    near = base.split()
    near[60] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, base.upper()), (5, base.replace(" ", " \t\n", 3)), (6, None), (7, ""), (8, " \n\t "), (9, "one two three"), (10, "ONE  two three"), (11, "a"), (None, base), (None, None)]
    rows += [(12, "x" * 3000), (13, "x" * 3000 + " y"), (14, " ".join(rng.choice(words) for _ in range(30_000))), (15, "the same " * 300)]
    rows += [(20, "twice the same row here"), (20, "twice the same row here"), (21, base), (21, " ".join(words[:80]))]
    rows += [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for k in range(30)]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """These rows as documents, with other columns null and extra ones of clashing names."""
    names = [c.split()[0] for c in CLASHING.split(", ")]
    rows = [(i, t, None, None if k % 3 else "s", None, *["z"] * len(names)) for k, (i, t) in enumerate(edge_rows)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(3)
