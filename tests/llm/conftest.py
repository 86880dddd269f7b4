import random

import pytest

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "sta", "tro", "wen") for b in ("", "r", "ng", "ldo", "sk", "ve")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


#: Names that the operators use inside; a table that has them too must not disturb.
CLASH = "lang string, source string, n_chars int, block int, shard int, node long, family long, component long, rep long, n long, h string, kept boolean, key long, part int, tree int, leaf int, host string, low int"


@pytest.fixture(scope="session")
def table(spark):
    def make(rows, id_type="long"):
        more = ["en", "s", 1, 2, 3, 4, 5, 6, 7, 8, "h", False, 9, 1, 1, 1, "h", 1]
        return spark.createDataFrame([(i, t, *more) for i, t in rows], f"doc_id {id_type}, text string, {CLASH}")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty texts, ties, repeated rows, a long text, copies and near copies."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (5, base), (3, base), (9, " ".join(near)), (9, " ".join(near)), (1, None), (2, ""), (4, " \t\n "), (None, base), (None, None),
        (6, "one two three"), (7, "One TWO three"), (8, prose(2, 9000)), (10, "Ünï çødé 漢字 🙂 " + prose(3, 70)), (11, prose(4, 55) + "\n" + base[:400]),
    ]
