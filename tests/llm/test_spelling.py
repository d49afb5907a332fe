import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import prose
from tripfold.llm import op11_spelling_variants as S


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(texts):
    """The contract, word by word; texts: pairs of id and text."""
    count = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def spelt(seed: int, n: int) -> list:
    """Texts over a small alphabet, so that near words are many; a third of the words are an edit away from more frequent ones."""
    rng = np.random.default_rng(seed)
    words = []
    for k in range(n):
        w = list(rng.choice(list("abÉéz÷"), rng.integers(6, 9)) if k % 3 == 0 else words[-1])
        if k % 3:
            w[int(rng.integers(len(w)))] = rng.choice(["", "b", "É", "zz"])
        words += ["".join(w)]
    each = [w for k, w in enumerate(words) for _ in range((200, 30, 6)[k % 3])]
    each = [w.upper() if rng.random() < 0.1 else w for w in rng.permutation(each)]
    return [" ".join(each[k::40]) for k in range(40)]


ODD = [None, "", " ", "12 %% ×", "short", "a" * 40_000, ("a" * 39_999 + " ") * 3, ("a" * 39_999 + "\n") * 6, ("a" * 40_000 + "-") * 6, "ÀÀÀÀÀÀ " * 6, "ÀÀÀÀÀÿ." * 7, "ſ日本語テキスト " * 9]


@pytest.mark.parametrize("block,seed", [(1 << 15, 0), (7, 1), (3, 2)])
def test_against_brute_force(spark, frame, monkeypatch, block, seed):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "STATES", 50 * block)
    monkeypatch.setattr(S, "PAIRS", 40 * block)
    texts = [*spelt(seed, 250), *ODD, *[prose(1, 300)] * 7]
    docs = frame(texts).unionByName(frame([texts[0]] * 2).selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars", "score", "token", "_id"))
    want = brute([*enumerate(texts), (None, texts[0]), (None, texts[0])])
    assert sum(w[1] is not None for w in want) > 20 and any(w[2] != w[1] and w[1] for w in want)
    assert sorted(map(tuple, S.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0]) == want


def test_the_number_of_top_groups_does_not_matter(frame, monkeypatch):
    docs = frame(spelt(5, 200))
    want = sorted(map(tuple, S.spelling_variants(docs).collect()), key=str)
    assert S.top_groups(10**6) == 3 and S.top_groups(10**6 + 1) == 4 and S.top_groups(4 * 10**7) == 6
    for top in (1, 6, S.GROUPS):
        monkeypatch.setattr(S, "top_groups", lambda n, top=top: top)
        assert sorted(map(tuple, S.spelling_variants(docs).collect()), key=str) == want


def test_no_words(frame):
    assert S.spelling_variants(frame(["x"]).limit(0)).count() == 0
    assert S.spelling_variants(frame([None, "", "two words"])).count() == 0
