"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (runs of PASSAGE words; the last may be shorter). Each passage is
encoded: mean of learned vectors of its words and of its words' shapes, plus a few figures, through
tanh. Gated attention, softmax(w . tanh(V h) * sigmoid(U h)) over the bag, weighs the passages, and a
logistic layer scores the weighted sum. Encoder, attention and output layer are trained together from
document labels alone.

Training rows are a sample bounded by MAX_TRAIN (by hash of doc_id, so reruns agree); one task fits
the model, whose size is fixed. Scoring is one pass over all documents without a shuffle.

Cases: a null or empty text is a bag of one empty passage and gets a score like any other; without any
usable label every score is 0.5; of several labels of a document the larger counts, and of several rows with
its id the first text in order is learned from; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tripfold.llm.common import crc_mod, hash_words, lean, one_of_each_id

PASSAGE = 64  # words of a passage
WORDS, SHAPES, DIM, ATT = 1 << 14, 1 << 10, 16, 12  # rows of the vector tables, encoder and attention width
MAX_TRAIN = 6_000  # labelled documents the model is fitted on, at most
EPOCHS, BATCH, RATE = 6, 64, 0.01
STEPS = 200  # updates, at least: small samples are gone through more often
CUT = 0.7  # a document is accepted from this score on
FIGURES = 6

_SHAPE = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256)
)
_RUN = re.compile(rb"([Aa0])\1+")


def passages(texts: list) -> dict:
    """Word and shape rows of all texts' passages, end to end, and where passages and documents begin."""
    words, shapes, starts, doc_starts, n_words = [], [], [], [], []
    at = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        w = raw.split()
        words += w
        shapes += _RUN.sub(rb"\1", raw.translate(_SHAPE)).split()
        doc_starts.append(len(starts))
        for p in range(0, len(w), PASSAGE) or [0]:
            starts.append(at + p)
            n_words.append(min(PASSAGE, len(w) - p) if w else 0)
        at += len(w)
    h = hash_words(words)
    s = hash_words(shapes)
    n = np.array(n_words, np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    figures = np.zeros((len(n), FIGURES), np.float32)
    full = np.maximum(n, 1)
    figures[:, 0] = n / PASSAGE
    if len(h):
        order = np.lexsort((h, owner))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])]
        figures[:, 1] = np.bincount(owner[order], new, len(n)) / full  # share of distinct words
        same = np.r_[False, (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])]
        figures[:, 2] = np.bincount(owner, same, len(n)) / full  # share that repeats the word before
        length = np.fromiter(map(len, words), np.int64, len(words))
        figures[:, 3] = np.bincount(owner, length, len(n)) / full / 10
        figures[:, 4] = np.bincount(owner, length <= 2, len(n)) / full
    figures[:, 5] = n == 0
    return {
        "word": (h & np.uint64(WORDS - 1)).astype(np.int32),
        "shape": (s & np.uint64(SHAPES - 1)).astype(np.int32),
        "owner": owner,
        "n": n,
        "figures": figures,
        "docs": np.array(doc_starts, np.int64),
    }


def new_model(rng: np.random.Generator) -> dict:
    g = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    return {
        "word": g(WORDS, DIM) * 0.1, "shape": g(SHAPES, DIM), "fig": g(FIGURES, DIM), "bias": np.zeros(DIM, np.float32),
        "V": g(DIM, ATT), "U": g(DIM, ATT), "w": g(ATT), "out": g(DIM), "out0": np.zeros(1, np.float32),
    }


def _spread(table: np.ndarray, rows: np.ndarray, bag: dict) -> np.ndarray:
    """Mean of the table's rows over each passage; all zeros for an empty one."""
    out = np.zeros((len(bag["n"]), table.shape[1]), np.float32)
    full = bag["n"] > 0
    if full.any():
        first = np.r_[0, np.cumsum(bag["n"])[:-1]][full]
        out[full] = np.add.reduceat(table[rows], first, axis=0) / bag["n"][full, None]
    return out


def forward(m: dict, bag: dict) -> dict:
    h = np.tanh(_spread(m["word"], bag["word"], bag) + _spread(m["shape"], bag["shape"], bag) + bag["figures"] @ m["fig"] + m["bias"])
    t, s = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (t * s) @ m["w"]
    size = np.diff(np.r_[bag["docs"], len(e)])
    doc = np.repeat(np.arange(len(size)), size)
    e = np.exp(e - np.maximum.reduceat(e, bag["docs"])[doc])
    a = e / np.add.reduceat(e, bag["docs"])[doc]
    z = np.add.reduceat(a[:, None] * h, bag["docs"], axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ m["out"] + m["out0"], -30, 30)))
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": p, "doc": doc}


def backward(m: dict, bag: dict, f: dict, y: np.ndarray) -> dict:
    d = ((f["p"] - y) / len(y)).astype(np.float32)
    g = {"out": f["z"].T @ d, "out0": d.sum(keepdims=True)}
    dz = d[:, None] * m["out"]
    da = (dz[f["doc"]] * f["h"]).sum(1)
    dh = f["a"][:, None] * dz[f["doc"]]
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, bag["docs"])[f["doc"]])
    g["w"] = (f["t"] * f["s"]).T @ de
    dt = de[:, None] * m["w"] * f["s"] * (1 - f["t"] ** 2)
    ds = de[:, None] * m["w"] * f["t"] * f["s"] * (1 - f["s"])
    g["V"], g["U"] = f["h"].T @ dt, f["h"].T @ ds
    dh += dt @ m["V"].T + ds @ m["U"].T
    dx = dh * (1 - f["h"] ** 2)
    g["bias"], g["fig"] = dx.sum(0), bag["figures"].T @ dx
    per_word = (dx / np.maximum(bag["n"], 1)[:, None])[bag["owner"]]
    for name in ("word", "shape"):
        g[name] = np.zeros_like(m[name])
        if len(bag[name]):
            order = np.argsort(bag[name], kind="stable")
            rows = bag[name][order]
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            g[name][rows[first]] = np.add.reduceat(per_word[order], first, axis=0)
    return g


def fit(texts: list, labels: np.ndarray, seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    m = new_model(rng)
    mean = {k: np.zeros_like(v) for k, v in m.items()}
    var = {k: np.zeros_like(v) for k, v in m.items()}
    m["out0"][:] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    round_ = -(-len(texts) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // round_))
    step, steps = 0, epochs * round_
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(texts), BATCH):
            pick = order[k : k + BATCH]
            bag = passages([texts[i] for i in pick])
            g = backward(m, bag, forward(m, bag), labels[pick])
            step += 1
            rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, x in g.items():
                mean[name] += 0.1 * (x - mean[name])
                var[name] += 0.001 * (x * x - var[name])
                m[name] -= (rate * mean[name] / (np.sqrt(var[name]) + 1e-8)).astype(np.float32)
    return m


def _packed(m: dict) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **m)
    return out.getvalue()


def train_rows(docs: DataFrame, labels: DataFrame, label: str, kept, most: int) -> DataFrame:
    """text and label of at most `most` labelled documents that satisfy kept, drawn by hash of doc_id."""
    ids = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isNotNull())
        .withColumn("_kept", kept("_id")).where("_kept")
        .groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(most)
    )
    return one_of_each_id(docs, ids)


def train(docs: DataFrame, labels: DataFrame, kept, most: int = MAX_TRAIN) -> dict | None:
    """The model, fitted in one task; None without labelled rows. kept: the fold, a function of the id column."""

    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: r["doc_id"])
        if rows:
            m = fit([r["text"] for r in rows], np.array([r["_y"] for r in rows], np.float32))
            yield pa.RecordBatch.from_pydict({"model": [_packed(m)]})

    got = train_rows(docs, labels, "quality", kept, most).repartition(1).mapInArrow(run, "model binary").collect()
    return dict(np.load(io.BytesIO(got[0]["model"]))) if got else None


def score(docs: DataFrame, model: dict | None, keep: list | None = None) -> DataFrame:
    """The columns `keep` (doc_id unless given) and score, one row per input row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the corpus
    keep = keep or ["doc_id"]
    given = docs.select(F.col("text").alias("_text"), *keep)

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                n = part.num_rows
                p = np.full(n, 0.5) if held.value is None else forward(held.value, passages(part.column(0).to_pylist()))["p"]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(p.astype(np.float64))], [*keep, "score"])

    return given.mapInArrow(run, StructType([*given.select(keep).schema, StructField("score", DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels of the held-out fold aren't used."""
    model = train(docs, labels, lambda c: crc_mod(c, 4) != 2)
    return score(docs, model).select(
        "doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def op2_quality_mil(spark, sf_dir: str) -> DataFrame:
    lean(spark)
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
