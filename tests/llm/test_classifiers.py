import numpy as np
import pytest

from tests.llm.conftest import junk, prose
from tripfold.llm import op2_quality_mil as Q
from tripfold.llm import op10_toxicity_counterfactual as T
from tripfold.llm.common import crc_mod

ODD = [None, "", " ", "one", "\x00   é", prose(9, 8000)]


@pytest.fixture(scope="module")
def corpus(spark, frame):
    bad, toxic = [i % 4 == 0 for i in range(300)], [i % 3 == 0 for i in range(300)]
    texts = [(junk if b else prose)(i, 60 + i % 90) + (" You idiot clown." if t else "") for i, (b, t) in enumerate(zip(bad, toxic))] + ODD + [prose(1, 61)] * 2
    labels = spark.createDataFrame([(i, int(not bad[i]), int(toxic[i]), "x") for i in range(300)] + [(None, 1, 1, "x"), (5, None, None, "x"), (7, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    return frame(texts), labels


@pytest.mark.parametrize("f,label,n", [(Q.quality, "quality", 4), (T.toxicity, "toxic", 5)])
def test_held_out_accuracy_and_odd_texts(corpus, f, label, n):
    docs, labels = corpus
    got = f(docs, labels).toPandas()
    assert len(got) == 308 and got.score.between(0, 1).all()
    truth = labels.where(f"{label} is not null and doc_id is not null").dropDuplicates(["doc_id"]).toPandas().set_index("doc_id")[label]
    held = got[got.held_out & got.doc_id.isin(truth.index)]
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.93
    twins = got[got.doc_id.isin([306, 307])]
    assert twins.score.nunique() == 1


def test_held_out_labels_do_not_matter(spark, corpus):
    docs, labels = corpus
    other = labels.where(crc_mod("doc_id", 4) != 2).unionByName(labels.where(crc_mod("doc_id", 4) == 2).selectExpr("doc_id", "1 - quality as quality", "toxic", "text"))
    a, b = (Q.quality(docs, x).orderBy("doc_id").toPandas().score for x in (labels, other))
    assert np.array_equal(a, b)


@pytest.mark.parametrize("f", [Q.quality, T.toxicity])
def test_no_labels_and_no_documents(corpus, f):
    docs, labels = corpus
    assert set(f(docs.limit(3), labels.limit(0)).toPandas().score) == {0.5}
    assert f(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("f", [Q.quality, T.toxicity])
def test_repeated_ids_are_learned_from_once(spark, corpus, f):
    docs, labels = corpus
    more = docs.unionByName(docs.where("doc_id < 9").withColumn("text", Q.F.lit("~ later in order")))
    a, b = (f(d, labels).where("doc_id >= 9").orderBy("doc_id").toPandas().score for d in (docs, more))
    assert np.array_equal(a, b)


def test_swaps_against_listing():
    texts = ["We saw the women. The men, the black cat! And", "", "old people? young people", "none here. none there"]
    docs = [T.sentences(t) for t in texts]
    vocab = np.unique(np.concatenate([x for d in docs for x in d]))
    s = T.Swaps(docs, vocab)
    assert s.blank.tolist() == [1, 1, 0, 2] and np.diff(s.first).tolist() == [3, 0, 2, 0]
    h = lambda w: int(T.hash_words([w.encode()])[0])
    rng, seen = np.random.default_rng(1), set()
    for _ in range(200):
        old, new = s.drawn(np.array([0, 2]), rng)
        assert len(old) == 6
        assert (old != new).any() and all(a != b for a, b in zip(old, new) if a >= 0)
        seen |= set(vocab[new[new >= 0]].tolist())
    assert seen == {h(w) for w in ("women", "men", "black", "old", "young")}
    assert all(T._GROUP[int(T.TERMS[a])] == T._GROUP[int(T.TERMS[b])] for a in range(len(T.TERMS)) for b in T._BY_KIND[T._KIND_FIRST[T._KIND[a]] :][: T._KIND_SIZE[T._KIND[a]]])


def test_attention_gradients_against_differences():
    rng = np.random.default_rng(0)
    m = {k: v.astype(np.float64) for k, v in Q.new_model(rng).items()}
    bag, y = Q.passages([prose(1, 200), "", prose(2, 70)]), np.array([1.0, 0.0, 0.0])
    loss = lambda: -(y * np.log(Q.forward(m, bag)["p"]) + (1 - y) * np.log(1 - Q.forward(m, bag)["p"])).mean()
    g = Q.backward(m, bag, Q.forward(m, bag), y)
    for name, at in (("V", (0, 0)), ("U", (2, 1)), ("w", (3,)), ("out", (1,)), ("fig", (0, 2)), ("shape", (int(bag["shape"][0]), 1))):
        old = m[name][at]
        m[name][at] = old + 1e-2
        up = loss()
        m[name][at] = old - 1e-2
        down = loss()
        m[name][at] = old
        assert abs((up - down) / 2e-2 - g[name][at]) < 2e-4, name


def test_swapped_identity_terms_change_little():
    texts = [f"people like the {w} folk here and that is {'idiot' if i % 2 else 'fine'} {prose(i, 12)}" for i in range(400) for w in [["women", "men"][i % 2]]]
    labels = np.array([float(i % 2) for i in range(400)])
    gap = {}
    for weight in (0.0, 30.0):
        T.SWAP, old = weight, T.SWAP
        m = T.fit(texts, labels)
        T.SWAP = old
        logit = lambda t, m=m: T.Batch([T.sentences(t)], m["vocab"]).logits(m["w"])[0]
        gap[weight] = abs(logit("we saw the men") - logit("we saw the women"))
    assert gap[30.0] < 0.3 * gap[0.0]
