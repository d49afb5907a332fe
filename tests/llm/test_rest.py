import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SF
from tests.llm.conftest import prose
from tripfold.llm import op5_source_mix as M
from tripfold.llm import op6_gru_lm as L
from tripfold.llm import op7_site_lines as N
from tripfold.llm import op8_html_boosted as H
from tripfold.llm import op9_token_index as X
from tripfold.llm.common import shared_folder


# --- 5: mixing
def levels(sizes):
    """Targets by sharing out again and again what is above the cap."""
    w = {s: M.WEIGHTS[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    target, open_, left = {}, set(sizes), sum(sizes.values())
    while True:
        share = left / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if w[s] * share >= 3 * sizes[s]}
        if not over:
            return target | {s: w[s] * share for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over


@pytest.mark.parametrize("sources", [["a", "b", "c", None], ["big"] * 20 + ["b", "é", None], ["one"]])
def test_mix(frame, sources):
    docs = frame([prose(i, 1 + i % 50) for i in range(400)] + [None, "", " "], sources)
    got = M.source_mix(docs).toPandas().merge(docs.select("doc_id", "source").toPandas())
    got["source"] = got.source.where(got.source.notna(), None)
    sizes = {}
    for s, n in zip(got.source, got["size"]):
        s = None if s is None or s != s else s
        sizes[s] = sizes.get(s, 0) + n
    want = levels(sizes)
    assert (got.taken <= 3 * got["size"]).all() and got.taken.sum() <= got["size"].sum()
    for s, t in want.items():
        mine = got[got.source.isna()] if s is None else got[got.source == s]
        assert (mine.source_size == sizes[s]).all() and np.allclose(mine.target, t, atol=1e-5)
        assert abs(mine.taken.sum() - t) <= 150
    again = M.source_mix(docs).toPandas().sort_values("doc_id")
    assert (again.taken.values == got.sort_values("doc_id").taken.values).all()
    assert M.mixed_rows(docs).count() == int((got.taken[got["size"] > 0] / got["size"][got["size"] > 0]).sum())


@pytest.mark.parametrize("sources", [["a", "b", "c", None], ["big"] * 9 + ["b", "c"]])
def test_mix_against_a_replayed_queue(frame, sources):
    docs = frame([prose(i, 1 + i * 7 % 60) for i in range(150)] + [None, ""], sources)
    hashes = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", f"shiftrightunsigned(xxhash64(doc_id, {M.SEED}), 1) as h").collect()}
    rows = M.source_mix(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    copies, total = [], sum(r["size"] for r in rows)
    for s in set(source.values()):
        at = 0
        for r in sorted((r for r in rows if source[r["doc_id"]] == s), key=lambda r: (hashes[r["doc_id"]], r["doc_id"])):
            at += r["size"]
            if r["size"]:
                copies += [((k * r["source_size"] + at) / r["target"], hashes[r["doc_id"]], r["doc_id"], k, r["size"]) for k in range(M.REPEATS)]
    taken, left = Counter(), total
    for *_, i, _, n in sorted(copies):
        if n > left:
            break
        taken[i] += n
        left -= n
    assert {r["doc_id"]: r["taken"] for r in rows if r["taken"]} == dict(taken)


def test_mixed_rows_with_null_and_repeated_ids(spark):
    rows = [(i % 7 if i % 3 else None, prose(i, 20 + i % 5), "en", ["a", "b", None][i % 3], 5) for i in range(90)] + [(1, prose(500, 20), "en", "a", 5)] * 4 + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(map(tuple, M.mixed_rows(docs).collect()))
    times = Counter()
    for r in M.queue(M.with_marks(docs), M.MARKS).where("_n > 0").collect():
        times[r["_mark_a"]] += r["_n"]
    marks = {r["_mark_a"]: tuple(r[:5]) for r in M.with_marks(docs).collect()}
    assert got == Counter({marks[m]: n for m, n in times.items()}) and any(r[0] is None for r in got) and sum(got.values()) > 80
    assert all(n <= M.REPEATS * rows.count(r) for r, n in got.items())


def test_mix_of_nothing(frame):
    assert M.source_mix(frame(["x"]).limit(0)).count() == 0
    assert [r["taken"] for r in M.source_mix(frame([None, ""])).collect()] == [0, 0]


# --- 6: language model
def test_scores_and_base(frame):
    # two kinds of documents, told apart by any of their words
    texts = [prose(i, 40 + i % 30).replace(" ", "q " if i % 2 else "z ") for i in range(240)] + [None, "", "unseen-word " * 5, prose(3, 5000)]
    got = L.language_model(frame(texts)).orderBy("doc_id").toPandas()
    count = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10 for w in L.tokens_of(t))
    total, distinct = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        words = L.tokens_of(t)
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        r = got.iloc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words), sum(count[w] > 0 for w in words), total, zlib.crc32(str(i).encode()) % 10 == 0)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score <= 0 and math.isfinite(r.score)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_probabilities_add_up():
    words = [b"a", b"bb", b"ccc", b"dddd"]
    lex = L.Lexicon(words, np.array([4.0, 3.0, 2.0, 1.0]), np.full(L.CLASSES, 5.0), np.full(L.CLASSES, 2.0), 10, 4)
    m = L.new_model(lex)
    rng = np.random.default_rng(0)
    m["Wc"], m["Wo"] = rng.normal(0, 1, m["Wc"].shape).astype(np.float32), rng.normal(0, 1, m["Wo"].shape).astype(np.float32)
    h = np.repeat(rng.normal(0, 1, (1, L.HIDDEN)).astype(np.float32), len(lex.mass), 0)
    assert math.isclose(float(np.exp(L.class_scores(m, lex, h, np.arange(len(lex.mass)))).sum()), 1, rel_tol=1e-4)


def test_gradients_against_differences(monkeypatch):
    monkeypatch.setattr(L, "STEPS", 6)
    lex = L.Lexicon([b"a", b"bb", b"ccc"], np.array([4.0, 3.0, 2.0]), np.full(L.CLASSES, 5.0), np.full(L.CLASSES, 2.0), 9, 3)
    m = L.new_model(lex)
    docs = [lex.slot[[0, 1, 2, 0, 1]], lex.slot[[2, 2, 1]]]
    slots, start, lengths, _ = L.laid(docs, 2)

    def loss(m):
        h, begin = L.states(m, slots, start, lengths)
        flat = np.concatenate([row[: b - a] for row, a, b in zip(slots, begin, begin[1:])])
        return -float(L.class_scores(m, lex, h, flat).mean())

    better = L.train(m, lex, docs, 40, 0.02)
    assert loss(better) < loss(m) - 0.3


def test_states_do_not_depend_on_lanes_or_windows():
    lex = L.Lexicon([b"a", b"bb", b"ccc"], np.array([4.0, 3.0, 2.0]), np.full(L.CLASSES, 5.0), np.full(L.CLASSES, 2.0), 9, 3)
    m = L.new_model(lex)
    docs = [lex.slot[np.random.default_rng(i).integers(0, 3, 5 + 7 * i)] for i in range(6)]
    alone = [L.states(m, *L.laid([d], 1)[:3])[0] for d in docs]
    slots, start, lengths, place = L.laid(docs, 3)
    h, begin = L.states(m, slots, start, lengths)
    for d, (lane, s), want in zip(docs, place, alone):
        assert np.allclose(h[begin[s : s + len(d)] + lane], want, atol=1e-5)


def test_every_training_document_reaches_the_network(spark, frame, monkeypatch):
    monkeypatch.setattr(L, "FIRST", 1)
    texts = [f"own{i} {prose(i, 12)}" for i in range(200)]
    docs = frame(texts).repartition(3)
    lex = L.lexicon(L.counted(docs))
    new, got = L.new_model(lex), L.fitted(docs, spark.sparkContext.broadcast(lex), lex)
    own = [lex.slot[lex.words.index(b"own%d" % i)] for i in range(200)]
    assert (got["E"][own] != new["E"][own]).any(1).all()


def test_language_model_with_null_and_repeated_ids(spark):
    rows = [(None if i % 4 == 0 else i % 5, prose(i, 30)) for i in range(60)]
    got = L.language_model(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 60 and all(math.isfinite(r["score"]) for r in got)


def test_language_model_of_nothing(frame):
    assert L.language_model(frame(["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("known", [[], [b"the", b"a"], [b"\n", b"the", b"a", b"c"]])
def test_look_up_of_a_batch(known):
    texts = [" The  c\x0b\x0c\r\n\u00c0d ", None, "", "  ", "x unseen THE the unseen", "a\x1fb\x85c d the A", "unseen " * 5]
    lex = L.Lexicon(known, np.arange(len(known), 0, -1.0), np.full(L.CLASSES, 5.0), np.full(L.CLASSES, 2.0), 10, 4)
    got = L.looked_up(pa.array(texts, pa.string()), lex, lex.index())
    for k, t in enumerate(texts):
        words = L.tokens_of(t)
        rare = Counter(w for w in words if w not in known)
        assert (got["n_tokens"][k], got["n_known"][k]) == (len(words), sum(w in known for w in words))
        assert {x["word"]: x["n"] for x in got["rare"][k].as_py()} == rare
        assert np.frombuffer(got["slots"][k].as_py(), "<u2").tolist() == [lex.slot[known.index(w)] if w in known else lex.rest[L.class_of(w)] for w in words]


def test_sums_of_short_and_long_runs():
    first = np.r_[0, np.cumsum(np.r_[1, 3, 40, 1, L.RUN, L.RUN + 1, 20_000, 2])][:-1]
    x = np.random.default_rng(0).normal(0, 1, (first[-1] + 2, L.HIDDEN)).astype(np.float32)
    assert np.allclose(L.sums(x, L.runs(first, len(x)), np.empty_like(x)), np.add.reduceat(x.astype(float), first, axis=0), atol=1e-2)


def test_documents_held_out_have_slots_and_no_round(spark, frame):
    docs = frame([prose(i, 12) for i in range(40)])
    rows = L.slotted(docs.withColumn("held_out", docs.doc_id % 10 == 0), spark.sparkContext.broadcast(L.lexicon(L.counted(docs)))).toPandas()
    assert sorted(rows[rows.held_out].doc_id) == [0, 10, 20, 30] and set(rows["_slice"][rows.held_out]) == {L.SLICES}
    assert len(rows) == 40 and (rows["_slice"][~rows.held_out] < L.SLICES).all() and (rows.slots.str.len() == 2 * rows.n_tokens).all()


# --- 7: line dedup
def test_site_lines_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(map(tuple, con.execute(f"SELECT doc_id, text, n_lines, n_dropped FROM ({N.SQL})").fetchall()))
    assert sorted(map(tuple, N.op7_site_lines(spark, SF).select("doc_id", "text", "n_lines", "n_dropped").collect())) == want


def test_site_lines(spark, frame):
    texts = [f"menu\nown {i}\n\nmenu" for i in range(30)] + [None, "", "menu", "rare\nrare"]
    got = {r["doc_id"]: r for r in N.site_lines(frame(texts, ["s"] * 33 + [None]), "doc_id", "text", "source").collect()}
    assert (got[3]["text"], got[3]["n_lines"], got[3]["n_dropped"]) == ("own 3\n", 4, 2)
    assert [got[i]["text"] for i in (30, 31, 32, 33)] == ["", "", "", "rare\nrare"]
    plan = N.op7_site_lines(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert N.site_lines(frame(["x"]).limit(0), "doc_id", "text", "source").count() == 0


def test_site_pages_go_by_host(spark, monkeypatch):
    rows = [(i, ["http://A.example/x", "https://a.example:80/y?z", "http://b.example/", None, "no url"][i % 5], f"own {i}\n" + ("menu of a" if i % 5 < 2 else f"line {i}")) for i in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in N.site_pages(df, "page_id", "url", "html").collect()}
    assert got == {i: f"own {i}" + ("" if i % 5 < 2 else f"\nline {i}") for i in range(50)}
    monkeypatch.setattr(N, "LISTED", 0)
    assert {r["page_id"]: r["text"] for r in N.site_pages(df, "page_id", "url", "html").collect()} == got
    given = spark.read.parquet(f"{SF}/pages.parquet")
    assert N.site_pages(given, "page_id", "url", "html").count() == given.count()


# --- 8: HTML
def page(i: int, body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>{body}<footer>&copy; {i} foot</footer></body></html>"


def test_main_text(spark):
    own = [f"{prose(i, 40)} &amp; more" for i in range(60)]
    rows = [(i, "u", page(i, f"<div class='ad'>buy {prose(900 + i, 4)}</div><article><h1>Head {i}</h1><p>{t[:80]}<br>{t[80:]}<p><b>un</b>closed &lt;x&gt;<div class='comments'><p>nice {i}</p></div></article>")) for i, t in enumerate(own)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "plain &eacute;  text"), (103, "u", page(1, "<main><p>" + prose(5, 30))), (0, "u", rows[0][2]), (104, "u", "<p>a < b</p"), (105, "u", "</div><<>>&#x41;")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in H.main_text(df).collect()}
    for i, t in enumerate(own):
        assert got[i]["text"] == f"Head {i} {t[:80].strip()} {t[80:].strip()} unclosed <x>".replace("&amp;", "&")
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert got[100]["text"] == "" == got[101]["text"] and got[102]["text"] == "plain é text"
    assert got[103]["text"] == prose(5, 30)
    assert H.main_text(df).count() == len(rows) and H.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "before",
    [
        "<svg/>", "<svg class='i' />", "<button>hid", "<select><option>hid<option>hid", "<noscript>hid", "<template>hid", "<svg><path d='x'/>", "<button>hid<button>hid</button>",
        "<svg><g><svg><path/></svg>hid</g></svg>", "<template><div>hid</p></div><template>hid</template>hid</div></template>", "<button><div>hid</div>hid</button>",
        "<p><button><div>hid</div>hid</button></p>", "<svg><title/><style/></svg>", "<select><option>hid</select>", "<li><button>hid<li>", "<button/>", "<template/>",
    ],
)
@pytest.mark.parametrize("after", ["", "<button>hid</button>", "<svg><text>hid</text></svg>"])
def test_hidden_elements_before_an_article(before, after):
    assert H.texts_of([f"<body><div>{before}<article><p>the text</p></article>{after}</div><p>and <i>more</i></p></body>"], None) == ["the text and more"]


def test_trees_matter_where_no_tag_or_attribute_tells(spark):
    """Pages without attributes and with plain elements only: the trees find the main text by shape."""
    import re

    given = [r["html"] or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    trees = H.fitted(spark.read.parquet(f"{SF}/pages.parquet"))
    bare = [re.sub(r"(?i)<(/?)(?:nav|header|footer|aside|article|main|form|section)\b", r"<\1div", re.sub(r"""(?i)\s(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", h)) for h in given]
    want = H.texts_of(given, trees)
    words = lambda texts: [Counter(t.split()) for t in texts]

    def wrong(texts):  # words too many or too few
        return sum(((a - b) + (b - a)).total() for a, b in zip(words(texts), words(want)))

    with_trees, without = wrong(H.texts_of(bare, trees)), wrong(H.texts_of(bare, None))
    assert with_trees < 0.5 * without and with_trees < 0.05 * sum(w.total() for w in words(want))


def test_repeated_and_null_ids_of_pages(spark):
    rows = [(i % 3 if i % 4 else None, "u", page(i, f"<article><p>{prose(i, 30)}</p></article>")) for i in range(40)]
    got = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r["text"] for r in got) == sorted(prose(i, 30) for i in range(40))


def test_decoding_never_goes_back_inside():
    p = H.Page("<div><p>a</p><div><p>b</p></div></div><p>c</p>")
    rng = np.random.default_rng(2)
    for _ in range(50):
        inside = H.decoded(p, rng.normal(0, 6, len(p.tag)), np.ones(len(p.tag)))
        for k in range(1, len(p.tag)):
            path, j = [], k
            while j > 0:
                path.append(bool(inside[j]))
                j = p.parent[j]
            assert "".join("01"[x] for x in path[::-1]).strip("0").count("0") == 0


# --- 9: token files
@pytest.mark.parametrize("top", [1, 255, 256, 70_000, 2**31])
def test_codes(top):
    ids = np.random.default_rng(top).integers(0, top, 3000).astype(np.uint32)
    codes = X.Codes(X.encoded(ids))
    assert codes.all().tolist() == ids.tolist() and len(codes) == 3000
    assert [codes[i] for i in range(0, 3000, 7)] == ids[::7].tolist()
    empty = X.Codes(X.encoded(ids[:0]))
    assert len(empty) == 0 and empty.all().tolist() == []
    with pytest.raises(IndexError):
        codes[3000]


def test_index_round_trip(spark, frame, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(X.TOKENIZER)
    monkeypatch.setattr(X, "SEGMENT", 500)
    texts = [prose(i, 1 + 7 * i) for i in range(50)] + [None, "", " ", "It's A\x1ctest\tÉCOLE ΣΑΣ, don't! <|endoftext|>x y ét, İ Ǆ foo%%% 12a", prose(1, 20_000)]
    path = X.write_index(frame(texts).repartition(7), shared_folder(spark))
    got, at, every = X.read_index(spark, path).orderBy("doc_id").collect(), 0, []
    assert len(got) == len(texts)
    for r, t in zip(got, texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at, every = at + len(ids), every + ids
    places = [0, 1, at - 1, at // 2, 4999]
    found = X.tokens_at(spark, path, spark.createDataFrame([(p,) for p in [*places, 5, 5]], "place long")).collect()
    assert {r["place"]: r["id"] for r in found} == {p: every[p] for p in [*places, 5]} and len(found) == 7


def test_index_of_nothing(spark, frame):
    path = X.write_index(frame(["x"]).limit(0), shared_folder(spark))
    assert X.read_index(spark, path).count() == 0
