import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from shared import SCHEMA, make, prose  # noqa: E402


@pytest.fixture(scope="session")
def corpus():
    """Null, empty, blank, short, repeated, copied, nearly copied and long texts, shared passages, other scripts, ties and a null id."""
    rng = random.Random(5)
    base, passage = prose(rng, 300), prose(rng, 80)
    words = base.split()
    near = " ".join("zzz" if i in (50, 200) else w for i, w in enumerate(words))
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "One two three"), (6, base), (7, base), (8, near), (9, base.upper()),
        (10, prose(rng, 100) + " " + passage + " " + prose(rng, 40)), (11, passage + "\n" + prose(rng, 60)), (12, "a" * 5000), (13, "été ñandú 漢字 " * 30 + passage),
        (14, prose(rng, 20_000)), (6, base), (None, base), (None, None), (15, "\n".join([words_line(rng) for _ in range(6)] * 2)), (16, "x퟿\U0001f600 y\x85z w " * 20),
    ]
    return rows


def words_line(rng):
    return prose(rng, 14)


@pytest.fixture(scope="session")
def clashing(spark, corpus):
    """The corpus with columns of every type and of names that operators use themselves."""
    from pyspark.sql import functions as F

    d = make(spark, corpus)
    names = ("row", "k", "h", "c", "n", "key", "cls", "rest", "found", "identified", "line_counts", "removed_words", "spans", "blob", "id", "first", "kept", "component", "held_out", "host", "declared", "line", "words", "prior")
    d = d.withColumns({n: F.lit(n) for n in names})
    return d.withColumns({"at": F.lit("2024-01-01").cast("timestamp"), "pair": F.struct(F.lit(1).alias("text"), F.lit(2).alias("doc_id")), "nothing": F.lit(None).cast("array<decimal(9,2)>")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
