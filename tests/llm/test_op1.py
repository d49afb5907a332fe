import numpy as np
import pytest

from tests.llm.conftest import prose
from tripfold.llm import op1_decontamination as D

ITEMS = [prose(1000 + i, 30 + i) for i in range(6)]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(ITEMS)] + [(90, "two words", 1), (91, None, 1), (None, ITEMS[0], 1)], "item_id long, text string, score int")


def edited(text: str, share: float, seed: int) -> str:
    rng, out = np.random.default_rng(seed), []
    for w in text.split():
        k = rng.random()
        if k < share / 3:
            continue
        out += [w, "zebra"] if k < 2 * share / 3 else ["changed"] if k < share else [w]
    return " ".join(out)


def test_copies_and_edits_are_found_and_clean_texts_are_not(spark, frame, benchmark):
    texts = [prose(i, 200) for i in range(40)]
    leaks = {}
    for i, item in enumerate(ITEMS):
        texts[i] = texts[i] + " " + item.upper() + "\n" + texts[i]
        texts[10 + i] = prose(50 + i, 100) + " " + edited(item, 0.2, i) + " " + prose(70 + i, 100)
        leaks |= {i: i, 10 + i: i}
    texts += [None, "", " \n", ITEMS[2], ITEMS[2]]
    got = D.leaks(frame(texts), benchmark).collect()
    assert {r["doc_id"]: r["item_id"] for r in got} == leaks | {43: 2, 44: 2}
    assert all(r["score"] == 1.0 for r in got if r["doc_id"] < 6 or r["doc_id"] > 40)
    span = next(r for r in got if r["doc_id"] == 0)
    assert (span["start_word"], span["end_word"]) == (200, 200 + len(ITEMS[0].split()))
    assert sorted(r["doc_id"] for r in D.without_leaks(frame(texts), benchmark).collect()) == [i for i in range(45) if i not in leaks and i not in (43, 44)]


@pytest.mark.parametrize("every", [4, 5])
def test_edited_copies_alone_are_found(frame, benchmark, every):
    """No verbatim copy, and no SEED + 2 words in a row that are as they were; then one item verbatim too."""
    copies = [" ".join("changed" if k % every == every - 1 else w for k, w in enumerate(t.split())) for t in ITEMS]
    texts = [f"{prose(200 + i, 80)} {c} {prose(300 + i, 80)}" for i, c in enumerate(copies)] + [prose(400 + i, 200) for i in range(10)] + [ITEMS[2]]
    want = {(i, i) for i in range(len(ITEMS))} | {(16, 2)}
    assert {(r["doc_id"], r["item_id"]) for r in D.leaks(frame(texts), benchmark).collect()} == want
    assert sorted(r["doc_id"] for r in D.without_leaks(frame(texts), benchmark).collect()) == list(range(6, 16))


def test_frequent_seeds_go_where_rarer_ones_are_near(spark, frame, monkeypatch):
    monkeypatch.setattr(D, "FEW", 5)
    common = "one of the"
    items = [f"{prose(900, 8)} {common} {prose(901, 8)}", f"{common} {common} {common} {common}"]
    texts = [f"{common} {prose(i, 60)} {common}" for i in range(60)] + [items[0], prose(1, 30) + " " + items[1]]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(frame(texts), benchmark).collect()}
    assert got == {(60, 0), (61, 1)}
    block = D.Items(list(enumerate(items)))
    gram = D.ngram_hashes(D.words_of(common), D.SEED)[0]
    counts = D.document_counts(frame(texts), block)
    assert counts[np.searchsorted(block.distinct, gram)] == 62
    block.choose(counts, 5)
    assert set(block.item[block.grams == gram].tolist()) == set() and set(block.item.tolist()) == {0, 1}


def test_counts_of_documents_against_counting(frame):
    texts = [prose(i % 7, 40) for i in range(30)] + [ITEMS[0], ITEMS[0] + " " + ITEMS[0], None]
    items = D.Items(list(enumerate(ITEMS)))
    have = [set(D.ngram_hashes(D.words_of(t), D.SEED).tolist()) for t in texts]
    assert D.document_counts(frame(texts).repartition(3), items).tolist() == [sum(g in h for h in have) for g in items.distinct.tolist()]


def test_blocks_of_items_give_the_same(spark, frame, benchmark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 150)
    got = D.leaks(frame([ITEMS[3], prose(5, 80), ITEMS[5]]), benchmark)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(0, 3), (2, 5)}


def test_empty_tables(spark, frame, benchmark):
    assert D.leaks(frame(["x"]), benchmark.limit(0)).count() == 0
    assert D.leaks(frame(["x"]).limit(0), benchmark).count() == 0
    assert D.without_leaks(frame(["x"]), benchmark.limit(0)).count() == 1


def test_alignment_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        w, t = rng.integers(0, 6, rng.integers(3, 30)).astype(np.uint64), rng.integers(0, 6, rng.integers(3, 20)).astype(np.uint64)
        h = np.zeros((len(t) + 1, len(w) + 1))
        for i in range(1, len(t) + 1):
            for j in range(1, len(w) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if t[i - 1] == w[j - 1] else -D.OFF), h[i - 1, j] - D.OFF, h[i, j - 1] - D.OFF)
        assert D.align([w, w[:3]], [t, t])[0][0] == h.max()
