from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, label string, chunk int"


def _texts() -> list[str | None]:
    rng = random.Random(5)
    words = [a + b for a in ("ba", "ko", "Ti", "mé", "zu", "fra", "xo") for b in ("ra", "lo", "ni", "s", "tt", "ß.", "n,")]
    fresh = lambda n: [rng.choice(words) + str(rng.randrange(50)) for _ in range(n)]
    passage, base = fresh(60), fresh(300)
    out: list[str | None] = [None, "", " \n\t ", "one", "one two  three four", "One TWO three Four", "a b c d e", "a b c d e"]
    out += [" ".join(fresh(40) + passage + fresh(30)) for _ in range(4)]
    out += [" ".join(passage + fresh(5) + passage[:36]), " ".join(passage[:34]), " ".join(passage[10:45])]
    for k in (0, 1, 4, 8, 12, 30, 60):  # copies of one text with k words changed
        changed = list(base)
        for i in rng.sample(range(len(changed)), k):
            changed[i] = f"changed{k}x{i}"
        out.append(" ".join(changed))
    out += [" ".join(base).upper(), "\n".join(" ".join(fresh(12)) for _ in range(500)), "word " * 200, "x" * 5000]
    return out


@pytest.fixture(scope="session")
def texts():
    return _texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Edge cases, repeated rows, ids that repeat or are missing, columns whose names operators use themselves."""
    rows = [(i, t, "en", f"s{i % 3}", 0, i, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], rows[16], (None, texts[10], None, None, None, None, None, None), (3, "another text of one id", "en", None, 0, 0, "y", 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where(F.lit(False))


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]
