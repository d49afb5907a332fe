"""Toxicity: a counterfactual-regularised classifier.

A document's logit is a bias and the sum of the weights of its distinct words. Besides the log loss on
document labels, training cuts the documents into sentences, swaps the identity terms in the labelled ones for
terms of other groups and penalises the squared change of the logit, so that weight which a term draws only from
the company it keeps is taken from it. Every sentence of every training document counts in every pass; those
that name no group get a term put in on both sides, so the penalty also binds where the sample mentions few groups.

Training rows are a sample bounded by MAX_TRAIN (by hash of doc_id); one task fits the model. Words
seen in fewer than MIN_DOCS of them have no weight. Scoring is one pass without a shuffle.

Cases: a null or empty text has the bias alone for its logit; without any usable label every score is
0.5; of several labels of a document the larger counts, and of several rows with its id the first text in
order is learned from; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripfold.llm.common import crc_mod, hash_words, lean, one_of_each_id

MAX_TRAIN = 8_000  # labelled documents the model is fitted on, at most
MIN_DOCS = 4  # training documents that a word with a weight occurs in, at least
CHOOSE, EPOCHS, BATCH, RATE, SWAP = 16, 32, 256, 0.2, 1.0  # CHOOSE: passes that choose words; SWAP: weight of the penalty on swapped sentences
EXCESS = 3.0  # documents by which a word must lean to one label before it gets a weight (an L1 penalty)
CUT = 0.5
SENTENCE = 60  # words after which a sentence without an end is cut

#: Identity terms, a line for each kind of group.
IDENTITY = (
    ("woman", "man", "women", "men", "girl", "boy", "girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrant", "refugee", "citizen", "foreigner", "immigrants", "refugees", "citizens", "foreigners"),
    ("old", "young", "disabled", "blind", "deaf"),
)
_TERMS = {w: k for k, words in enumerate(IDENTITY) for w in words}
_GROUP = {int(h): k for h, k in zip(hash_words([w.encode() for w in _TERMS]), _TERMS.values())}
TERMS = np.array(sorted(_GROUP), np.uint64)
_KIND = np.array([_GROUP[int(t)] for t in TERMS])
_BY_KIND = np.argsort(_KIND, kind="stable")  # the terms of each kind side by side
_KIND_SIZE = np.bincount(_KIND)
_KIND_FIRST = np.cumsum(_KIND_SIZE) - _KIND_SIZE
_AMONG = np.empty(len(TERMS), np.int64)  # a term's place among its kind
_AMONG[_BY_KIND] = np.arange(len(TERMS)) - _KIND_FIRST[_KIND[_BY_KIND]]
_WORDS = re.compile(r"[^\W_]+|[.!?\n]+")


def sentences(text: str | None) -> list:
    """Sorted distinct word hashes of each sentence; one empty sentence if there are no words."""
    out, part = [], []
    for w in _WORDS.findall((text or "").lower()):
        if w[0] in ".!?\n" or len(part) >= SENTENCE:
            if part:
                out.append(part)
            part = []
        if w[0] not in ".!?\n":
            part.append(w.encode("utf-8", "surrogatepass"))
    if part:
        out.append(part)
    return [np.unique(hash_words(p)) for p in out] or [np.empty(0, np.uint64)]


class Batch:
    """Distinct words of some documents, as rows of the weights they use."""

    def __init__(self, docs: list, vocab: np.ndarray):
        words = np.concatenate([x for d in docs for x in d])
        doc = np.repeat(np.arange(len(docs)), [sum(map(len, d)) for d in docs])
        at = np.minimum(np.searchsorted(vocab, words), max(len(vocab) - 1, 0))
        known = vocab[at] == words if len(vocab) else np.zeros(len(words), bool)
        pair = np.unique(doc[known] * max(len(vocab), 1) + at[known])
        self.row, self.doc, self.n = pair % max(len(vocab), 1), pair // max(len(vocab), 1), len(docs)

    def logits(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, w[self.row], self.n) if len(self.row) else np.zeros(self.n)


class Swaps:
    """Identity terms of each document's sentences, listed once: their places in TERMS, and how many sentences name none."""

    def __init__(self, docs: list, vocab: np.ndarray):
        words = np.concatenate([x for d in docs for x in d])
        sentence = np.repeat(np.arange(sum(map(len, docs))), [len(x) for d in docs for x in d])
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])  # of each sentence
        at = np.minimum(np.searchsorted(TERMS, words), len(TERMS) - 1)
        hit = TERMS[at] == words
        self.term, named = at[hit], np.zeros(len(doc), bool)
        named[sentence[hit]] = True
        self.first = np.searchsorted(doc[sentence[hit]], np.arange(len(docs) + 1))
        self.blank = np.bincount(doc[~named], minlength=len(docs))
        place = np.minimum(np.searchsorted(vocab, TERMS), max(len(vocab) - 1, 0))
        self.row = np.where(vocab[place] == TERMS, place, -1) if len(vocab) else np.full(len(TERMS), -1)

    def drawn(self, pick: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of weight rows for every sentence of the picked documents: each identity term (any one, where there
        is none) and a term of another group that replaces it. -1: a term without a weight.

        With the words around it unchanged, the change of a sentence's logit is the difference of the two weights.
        """
        size = self.first[pick + 1] - self.first[pick]
        own = np.repeat(self.first[pick] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        old = np.r_[self.term[own], rng.integers(0, len(TERMS), self.blank[pick].sum())]
        begin, many, among = _KIND_FIRST[_KIND[old]], _KIND_SIZE[_KIND[old]], _AMONG[old]
        other = (rng.random(len(old)) * (many - 1)).astype(np.int64)
        return self.row[old], self.row[_BY_KIND[begin + other + (other >= among)]]


def fit(texts: list, labels: np.ndarray, seed: int = 11) -> dict:
    rng = np.random.default_rng(seed)
    docs = [sentences(t) for t in texts]
    seen, count = np.unique(np.concatenate([np.unique(np.concatenate(d)) for d in docs]), return_counts=True)
    vocab = seen[count >= MIN_DOCS]
    w, bias = np.zeros(len(vocab)), np.array([np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)) - 1])
    gw, gb = np.full(len(vocab), 1e-8), np.full(1, 1e-8)  # Adagrad
    x, named = Batch(docs, vocab), Swaps(docs, vocab)
    first = np.searchsorted(x.doc, np.arange(len(docs) + 1))
    rows = [x.row[i:j] for i, j in zip(first, first[1:])]
    for epoch in range(EPOCHS):
        choose = epoch < CHOOSE  # words are chosen first; then the chosen ones' weights are fitted without the L1 penalty
        if epoch == CHOOSE:
            gw[:], gb[:] = 1e-8, 1e-8
        order = rng.permutation(len(docs))
        for k in range(0, len(docs), BATCH):
            pick = order[k : k + BATCH]
            row = np.concatenate([rows[i] for i in pick])
            doc = np.repeat(np.arange(len(pick)), [len(rows[i]) for i in pick])
            z = np.bincount(doc, w[row], len(pick)) if len(row) else np.zeros(len(pick))
            d = (1 / (1 + np.exp(-np.clip(z + bias, -30, 30))) - labels[pick]) / len(pick)
            g = np.bincount(row, d[doc], len(vocab)) if len(row) else np.zeros(len(vocab))
            old, new = named.drawn(pick, rng)
            weight = lambda r: np.where(r >= 0, w[np.maximum(r, 0)] if len(w) else 0.0, 0.0)
            change = SWAP * 2 * (weight(old) - weight(new)) / max(1, len(old))
            for at, by in ((old, change), (new, -change)):
                g += np.bincount(at[at >= 0], by[at >= 0], len(vocab))
            if not choose:
                g[w == 0] = 0
            gw, gb = gw + g * g, gb + d.sum() ** 2
            w -= RATE * g / np.sqrt(gw)
            if choose:
                w = np.sign(w) * np.maximum(np.abs(w) - RATE * EXCESS / len(docs) / np.sqrt(gw), 0)
            bias = bias - RATE * d.sum() / np.sqrt(gb)
    kept = w != 0
    return {"vocab": vocab[kept], "w": w[kept], "bias": bias}


def train(docs: DataFrame, labels: DataFrame, kept, most: int = MAX_TRAIN) -> dict | None:
    """The model, fitted in one task; None without labelled rows. kept: the fold, a function of the id column."""

    def run(batches):
        rows = sorted(((r["doc_id"], r["text"] or "", r["_y"]) for b in batches for r in b.to_pylist()), key=lambda r: r[0])
        if rows:
            out = io.BytesIO()
            np.savez_compressed(out, **fit([t for _, t, _ in rows], np.array([y for _, _, y in rows])))
            yield pa.RecordBatch.from_pydict({"model": [out.getvalue()]})

    ids = (
        labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("double").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isNotNull()).where(kept("_id"))
        .groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    )
    got = one_of_each_id(docs, ids).repartition(1).mapInArrow(run, "model binary").collect()
    return dict(np.load(io.BytesIO(got[0]["model"]))) if got else None


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score, one row per input row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the corpus

    def run(batches):
        m = held.value
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                p = np.full(part.num_rows, 0.5)
                if m is not None:
                    x = Batch([sentences(t) for t in part.column(1).to_pylist()], m["vocab"])
                    p = 1 / (1 + np.exp(-np.clip(x.logits(m["w"]) + m["bias"], -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels of the held-out fold aren't used."""
    model = train(docs, labels, lambda c: crc_mod(c, 5) != 0)
    return score(docs, model).select(
        "doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def op10_toxicity_counterfactual(spark, sf_dir: str) -> DataFrame:
    lean(spark)
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
