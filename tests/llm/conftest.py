import random

import pytest

#: Names that the operators use inside, as extra columns of the inputs.
CLASHING = ["row", "id", "n", "pos", "uid", "name", "block", "fp", "unit", "node", "root", "part", "g", "c", "text_sha256",
            "ids", "start", "length", "runs", "carried", "spans", "keep", "kept", "_keep", "row_no"]


def passage(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def edge_documents() -> list[tuple]:
    """(doc_id, text): nulls, blanks, copies that differ in white space, near
    copies, shared passages, repeated rows and a very long text."""
    long = passage(1, 60_000)
    a, b, c = passage(2, 130), passage(3, 70), passage(4, 50)
    near = passage(5, 400)
    return [
        (5, None), (3, ""), (9, " \t\n "), (1, " "), (11, "One"), (12, "one  two"), (13, "one\ttwo"), (14, "one two"),
        (20, a), (21, passage(6, 30) + " " + a + " " + b), (22, b + " " + a), (23, a + "  "), (24, c), (25, c + " " + c),
        (26, passage(7, 10) + " " + c[:-1]), (27, "x " + c), (30, long), (31, long), (32, long[:-4] + " end"),
        (40, near), (41, near + " tail"), (42, near.replace("w1", "v1", 1)), (50, "a b c d"), (51, "ÉTÉ İ Σ"),
        (60, "dup row"), (60, "dup row"), (60, "other text"), (61, a), (None, a), (None, "no id"), (70, "the end " * 80),
        (71, "the end " * 80), (72, "so it goes " * 40),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, None if k % 5 == 0 else "en", "s", 0, *[f"x{k}"] * len(CLASHING)) for k, (i, t) in enumerate(edge_documents())]
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)
