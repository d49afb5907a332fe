import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, token string, _id long"  # the last three clash with names inside
SYLLABLES = "the of and to in an er on re ed is ing tion at or en es ha th ou sh st wh ly ble".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(SYLLABLES, rng.integers(1, 5))) for _ in range(n)]
    return " ".join(w + "." if i % 9 == 8 else w for i, w in enumerate(words))


def junk(seed: int, n: int) -> str:
    return " ".join(w + "%%%" for w in prose(seed, n).split())


def rows(texts, sources=None):
    return [(i, t, "en", (sources or ["a"])[i % len(sources or ["a"])], None if t is None else len(t), 1.0, "x", i) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def frame(spark):
    return lambda texts, sources=None: spark.createDataFrame(rows(texts, sources), DOCS)
