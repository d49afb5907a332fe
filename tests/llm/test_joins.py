import numpy as np
import pytest

from tests.llm.conftest import prose
from tripfold.llm import op3_improbable_digest as F3
from tripfold.llm import op4_ngram_jaccard_join as J
from tripfold.llm.common import shingle_hashes
from tripfold.llm.components import components


def brute(texts, words, percent):
    sets, parent = [set(shingle_hashes(t, words).tolist()) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def near_copies():
    rng, base = np.random.default_rng(4), [prose(s, 120).split() for s in range(5)]
    texts = []
    for i in range(160):
        w = list(base[i % 5])
        for k in rng.integers(0, len(w), rng.integers(0, 9)):
            w[k] = f"new{i}x{k}"
        texts.append(" ".join(w))
    return texts + [prose(100 + i, 60) for i in range(30)] + [None, "", " \t", "a b", "A  b", "a b c", texts[0], texts[0].upper(), prose(3, 9000), prose(3, 9000) + " end"]


@pytest.mark.parametrize("words,percent,block", [(4, 85, J.BLOCK), (5, 80, 500)])
def test_components_equal_brute_force(frame, monkeypatch, words, percent, block):
    monkeypatch.setattr(J, "BLOCK", block)
    texts = near_copies()
    got = {r["doc_id"]: r for r in J.ngram_jaccard_join(frame(texts), words, percent).collect()}
    want, sizes = brute(texts, words, percent)
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes


def test_one_of_each(frame):
    texts = near_copies()
    twice = frame(texts).unionByName(frame(texts).where("doc_id < 3"))
    kept = J.one_of_each(twice, 5, 80)
    want, _ = brute(texts, 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, c in enumerate(want) if i == c]
    assert kept.columns == twice.columns


def test_empty_tables(frame):
    assert J.ngram_jaccard_join(frame(["a"]).limit(0)).count() == 0
    assert J.ngram_jaccard_join(frame([None, ""])).count() == 2
    assert J.one_of_each(frame(["a"]).limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5), (7, 6), (6, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(40)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_entropies_against_counting():
    rng = np.random.default_rng(1)
    for n in (1, 31, 32, 33, 300):
        data = rng.integers(97, 107, n).astype(np.uint8)
        want = [(F3._TOP - int(F3._G[np.bincount(data[i : i + F3.WINDOW])].sum())) * (F3.LEVELS - 1) // F3._TOP for i in range(n - F3.WINDOW + 1)]
        assert F3.entropies(data).tolist() == want


def test_fingerprints(frame):
    import hashlib

    texts = [prose(i, 150) for i in range(30)] + [None, "", "tiny", "é" * 50, prose(40, 3000), prose(5, 150), prose(5, 150)]
    got = F3.fingerprints(frame(texts)).orderBy("doc_id").toPandas()
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        other = plain[(i + 1) % len(plain)]
        edited = t[: len(t) - len(t) // 4] + other[: len(t) // 4]
        assert (got.n_chars[i], got.edited_sha256[i]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert got.fingerprint[5] == got.fingerprint[35] == got.fingerprint[36] and got.near_next[35] == 1.0
    assert got.near_next[30] == 1.0 and got.near_next[31] == 0.0  # two texts without features; one without and one with
    assert got.near_edited[:29].mean() > 0.6 > 0.2 > got.near_next[:29].mean()
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()


def plain_chain(text: str, rank) -> list:
    """The filters of a text as sets of bits, window by window."""
    data = text.encode()
    kinds = []
    if len(data) >= F3.SHORT:
        windows = [data[i : i + F3.WINDOW] for i in range(len(data) - F3.WINDOW + 1)]
        step = [(F3._TOP - sum(int(F3._G[w.count(c)]) for c in set(w))) * (F3.LEVELS - 1) // F3._TOP for w in windows]
        near, votes = min(F3.NEAR, len(windows)), [0] * len(windows)
        for a in range(len(windows) - near + 1):
            votes[min(range(a, a + near), key=lambda i: (rank[step[i]], i))] += 1
        kinds.append([w for w, v in zip(windows, votes) if v >= min(F3.VOTES, max(votes))])
    if 0 < len(data) < 2 * F3.SHORT:
        padded = data.ljust(F3.SMALL, b"\0")
        kinds.append([padded[i : i + F3.SMALL] for i in range(len(padded) - F3.SMALL + 1)])
    chain = []
    for kind in kinds:
        h = F3.hashed(np.array([list(w) for w in kind], np.uint8))
        for k in range(0, len(h), F3.FEATURES):
            chain.append({int(F3.mixed(h[k : k + F3.FEATURES], 20 + j)[i] & np.uint64(F3.BITS - 1)) for j in range(F3.HASHES) for i in range(len(h[k : k + F3.FEATURES]))})
    return chain


def plain_likeness(a: list, b: list) -> float:
    if not a or not b:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    best = []
    for x in a:
        scores = []
        for y in b:
            most, chance = min(len(x), len(y)), len(x) * len(y) / F3.BITS
            scores.append((len(x & y) - chance) / (most - chance) if most > chance else float(len(x & y) >= most))
        best.append(max(scores))
    return min(1.0, max(0.0, sum(min(1, max(0, v)) for v in best) / len(best)))


def test_fingerprints_against_brute_force(frame):
    import base64

    texts = [prose(i, 5 + 6 * i) for i in range(14)] + [None, "", "t", "é" * 70, "=" * 200, "ha " * 100, prose(3, 500), prose(7, 200)[:130], prose(7, 200)[:255]]
    docs = frame(texts)
    rank, plain = F3.ranks(docs), [t or "" for t in texts]
    for r in F3.fingerprints(docs).collect():
        t, other = plain[r["doc_id"]], plain[(r["doc_id"] + 1) % len(plain)]
        edited = t[: len(t) - len(t) // 4] + other[: len(t) // 4]
        a, b, c = (plain_chain(x, rank) for x in (t, edited, other))
        bits = np.unpackbits(np.frombuffer(base64.b64decode(r["fingerprint"]), np.uint8)).reshape(-1, F3.BITS)
        assert [set(np.flatnonzero(x).tolist()) for x in bits] == a
        assert abs(r["near_edited"] - plain_likeness(a, b)) < 1e-9 and abs(r["near_next"] - plain_likeness(a, c)) < 1e-9


def test_repeated_patterns_have_features_of_their_own(frame):
    texts = ["=" * 200, "ha " * 100, "lorem " * 60, "abcdefgh" * 40, "-" * 300]
    got = F3.fingerprints(frame(texts)).toPandas()
    assert got.fingerprint.nunique() == len(texts) and (got.fingerprint != "").all() and (got.near_next < 0.5).all()


@pytest.mark.parametrize("n", [127, 128, 150, 165, 200, 255, 256, 300])
def test_a_cut_copy_is_alike_on_either_side_of_a_short_text(frame, n):
    got = F3.fingerprints(frame([prose(8, 300)[:n], ""])).orderBy("doc_id").first()
    assert got["near_edited"] > 0.5


def test_likeness_of_long_chains_goes_by_blocks():
    import tracemalloc

    rng = np.random.default_rng(0)
    a, b = (F3.digest([rng.integers(0, 2**63, 600 * F3.FEATURES).astype(np.uint64)]) for _ in range(2))
    tracemalloc.start()
    assert F3.likeness(a, a) == 1.0 and F3.likeness(a, b) < 0.2
    assert tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()


def test_fingerprints_of_one_and_of_none(frame):
    assert F3.fingerprints(frame([prose(1, 90)])).first()["near_next"] == 1.0
    assert F3.fingerprints(frame(["x"]).limit(0)).count() == 0


def test_one_of_each_with_null_and_repeated_ids(spark, frame):
    same = prose(1, 60)
    rows = [(None, same, "en", "a", 1), (None, prose(2, 60), "en", "a", 1), (None, None, "en", None, 1), (None, None, "en", None, 1), (3, same, "en", "a", 1), (3, prose(3, 60), "en", "a", 1), (3, prose(4, 60), "en", "b", 1),
            (3, prose(4, 60), "en", "b", 1), (4, prose(4, 60) + " more", "en", "b", 1), (5, prose(5, 60), None, None, None), (5, prose(5, 60), None, None, None), (2, prose(6, 60), "en", "a", 1), (9, prose(6, 60), "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(tuple, J.one_of_each(docs).collect()), key=str)
    want = [rows[i] for i in (1, 2, 3, 4, 5, 6, 9, 11)]
    assert got == sorted(want, key=str)
