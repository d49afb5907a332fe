"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are word n-grams of the test items that occur in the corpus, and are rare in it: at most one document
in RARE has them, or no more than FEW. Of the frequent ones, which would make most documents a candidate of
most items, only those stay that are the rarest of RUN n-grams in a row of their item, so that an item of
everyday words has seeds as well. Any SEED unchanged words in a row of a copy hold an n-gram of the item,
and a rare one is always a seed, however often its neighbours occur. A
document that holds a seed is aligned to the item around it, word by word (match 1, mismatch and gap
-0.5), unless it has too few of the item's words for a leak whatever their order. The best local score
divided by the item's words, 1 for a verbatim copy, tells copies with edits, insertions and changed words
from chance. Words are compared in lower case without ASCII punctuation.

Items are taken in blocks of at most about BLOCK bytes (by hash of item_id, as many blocks as the
benchmark needs); each block is broadcast and meets all documents in two scans, one that counts the
documents that have each n-gram and one that aligns. Documents aren't shuffled.

Cases: null or empty texts have no leaks; items of fewer than SEED words match nothing; two items with
equal texts both match; repeated document rows give repeated results; empty tables give no leaks.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripfold.llm.common import hash_words, lean, ngram_hashes

SEED = 3  # words of a seed
RARE, FEW, RUN = 50, 1_000, 3  # see above
LEAK = 0.5  # score from which a passage is a leak
OFF = 0.5  # cost of a mismatch or gap
BLOCK = 4_000_000  # bytes of the items that are broadcast together
SIEVE = 1 << 20
ALIGN, CELLS = 512, 1 << 20  # windows that are aligned together, and their words, at most


def words_of(text: str | None) -> np.ndarray:
    return hash_words((text or "").lower().encode("utf-8", "surrogatepass").translate(None, string.punctuation.encode()).split())


class Items:
    """A block of items: their words, and their n-grams in one sorted list."""

    def __init__(self, rows: list):
        self.ids = [i for i, _ in rows]
        self.words = [words_of(t) for _, t in rows]
        grams = [ngram_hashes(w, SEED) for w in self.words]
        self.grams = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        self.at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(self.grams, kind="stable")
        self.grams, self.item, self.at = self.grams[order], self.item[order], self.at[order]
        self.distinct = np.unique(self.grams)

    def choose(self, counts: np.ndarray, most: float) -> None:
        """Keeps the n-grams that are seeds. counts: of the documents that have each of the distinct ones."""
        count = counts[np.searchsorted(self.distinct, self.grams)].astype(float)
        count[count == 0] = np.inf
        order = np.lexsort((self.at, self.item))
        c, item = count[order], self.item[order]
        seed, full = c <= most, np.minimum(RUN, np.bincount(item)[item] if len(item) else 0)
        for k in range(RUN):  # the run that begins k places before; in a short item, all of it
            low, inside_n = np.full(len(c), np.inf), np.zeros(len(c), np.int64)
            for j in range(RUN):
                at = np.arange(len(c)) - k + j
                inside = (at >= 0) & (at < len(c))
                inside[inside] = item[at[inside]] == item[inside]
                low[inside] = np.minimum(low[inside], c[at[inside]])
                inside_n += inside
            seed |= (c == low) & np.isfinite(c) & (inside_n == full)
        keep = np.empty(len(c), bool)
        keep[order] = seed
        self.grams, self.item, self.at = self.grams[keep], self.item[keep], self.at[keep]
        self.distinct = np.unique(self.grams)

    def sieve(self) -> np.ndarray:
        out = np.zeros(SIEVE, bool)
        out[(self.distinct & np.uint64(SIEVE - 1)).astype(np.int64)] = True
        return out


def hits(grams: np.ndarray, distinct: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the n-grams that are among distinct, and which they are."""
    pos = np.flatnonzero(sieve[(grams & np.uint64(SIEVE - 1)).astype(np.int64)])
    which = np.minimum(np.searchsorted(distinct, grams[pos]), max(len(distinct) - 1, 0))
    ok = distinct[which] == grams[pos] if len(distinct) else np.zeros(len(pos), bool)
    return pos[ok], which[ok]


def align(windows: list, items: list) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each window against its item, and the window position where it ends."""
    wide, deep = max(map(len, windows)), max(map(len, items))
    w, t = np.zeros((len(windows), wide), np.uint64), np.zeros((len(items), deep), np.uint64)
    in_w, in_t = np.zeros(w.shape, bool), np.zeros(t.shape, bool)
    for k, (a, b) in enumerate(zip(windows, items)):
        w[k, : len(a)], in_w[k, : len(a)], t[k, : len(b)], in_t[k, : len(b)] = a, True, b, True
    slope = np.arange(wide, dtype=np.float32) * OFF
    row, best, end = np.zeros((len(windows), wide), np.float32), np.zeros(len(windows), np.float32), np.zeros(len(windows), np.int64)
    for i in range(deep):
        gain = np.where((w == t[:, i : i + 1]) & in_w & in_t[:, i : i + 1], np.float32(1), np.float32(-OFF))
        new = gain.copy()
        new[:, 1:] += row[:, :-1]
        np.maximum(new, row - np.float32(OFF), out=new)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope, axis=1) - slope  # gaps along the window
        at = row.argmax(1)
        top = row[np.arange(len(row)), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
    return best, end


def held_words(item: np.ndarray, have: np.ndarray) -> int:
    """How many of the item's words are among the sorted words have: no alignment scores more."""
    return int((have[np.minimum(np.searchsorted(have, item), len(have) - 1)] == item).sum())


def leaks_in(texts: list, items: Items, sieve: np.ndarray) -> list:
    """For each text the list of (item_id, score, first word, word after the last)."""
    out, jobs = [[] for _ in texts], []
    for d, text in enumerate(texts):
        words = words_of(text)
        pos, which = hits(ngram_hashes(words, SEED), items.distinct, sieve)
        if not len(pos):
            continue
        lo = np.searchsorted(items.grams, items.distinct[which], "left")
        n = np.searchsorted(items.grams, items.distinct[which], "right") - lo
        entry = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        item, diagonal = items.item[entry], np.repeat(pos, n) - items.at[entry]
        have = np.unique(words)
        ids, of = np.unique(item, return_inverse=True)
        enough = np.array([held_words(items.words[i], have) >= LEAK * len(items.words[i]) for i in ids])[of]
        if not enough.any():
            continue
        item, diagonal = item[enough], diagonal[enough]
        order = np.lexsort((diagonal, item))
        item, diagonal = item[order], diagonal[order]
        slack = np.array([len(items.words[i]) // 2 for i in item])
        new = np.r_[True, (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])]
        first = np.flatnonzero(new)
        for a, b in zip(first, np.r_[first[1:], len(item)]):
            long = len(items.words[item[a]])
            begin = max(0, int(diagonal[a]) - long // 2)
            jobs.append((d, int(item[a]), begin, words[begin : int(diagonal[b - 1]) + long + long // 2]))
    jobs.sort(key=lambda j: len(j[3]))
    best: dict = {}
    k = 0
    while k < len(jobs):
        end = k + 1
        while end < min(len(jobs), k + ALIGN) and (end + 1 - k) * len(jobs[end][3]) <= CELLS:
            end += 1
        part, k = jobs[k:end], end
        scores, ends = align([j[3] for j in part], [items.words[j[1]] for j in part])
        good = [(j, s, e) for j, s, e in zip(part, scores, ends) if s >= LEAK * len(items.words[j[1]])]
        if good:
            _, starts = align([j[3][: e + 1][::-1] for j, _, e in good], [items.words[j[1]][::-1] for j, _, _ in good])
            for (j, s, e), back in zip(good, starts):
                found = (float(s) / len(items.words[j[1]]), -(j[2] + int(e - back)), -(j[2] + int(e) + 1))
                if found > best.get(j[:2], (0,)):
                    best[j[:2]] = found
    for (d, i), (s, a, b) in sorted(best.items()):
        out[d].append((items.ids[i], round(s, 6), -a, -b))
    return out


def document_counts(docs: DataFrame, items: Items) -> np.ndarray:
    """How many documents have each of the items' distinct n-grams."""
    held = docs.sparkSession.sparkContext.broadcast((items.distinct, items.sieve()))

    def run(batches):
        total = np.zeros(len(held.value[0]), np.int64)
        for b in batches:
            found = [np.unique(hits(ngram_hashes(words_of(t), SEED), *held.value)[1]) for t in b.column(0).to_pylist()]
            if found:
                total += np.bincount(np.concatenate(found), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(len(items.distinct), np.int64)
    for r in docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row for each n-gram of a block
        out[r["at"]] = r["n"]
    held.destroy()
    return out


def blocks(docs: DataFrame, benchmark: DataFrame):
    """Blocks of items with their seeds, broadcast one after another."""
    spark = docs.sparkSession
    given = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    size = given.agg(F.sum(F.length("text"))).first()[0] or 0
    n, most = -(-size // BLOCK), max(FEW, docs.count() / RARE)
    for k in range(n):
        rows = given.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()  # about BLOCK bytes
        items = Items(sorted((r["item_id"], r["text"]) for r in rows))
        items.choose(document_counts(docs, items), most)
        yield spark.sparkContext.broadcast((items, items.sieve()))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word for every document and item that it leaks."""
    schema = "doc_id long, item_id long, score double, start_word long, end_word long"
    found = docs.sparkSession.createDataFrame([], schema)
    for held in blocks(docs, benchmark):

        def run(batches, held=held):
            for b in batches:
                ids = b.column(0).to_pylist()
                rows = [(i, *x) for i, xs in zip(ids, leaks_in(b.column(1).to_pylist(), *held.value)) for x in xs]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["doc_id", "item_id", "score", "start_word", "end_word"])

        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item."""
    clean = docs
    for held in blocks(docs, benchmark):

        def run(batches, held=held):
            for b in batches:
                texts = b.column(b.num_columns - 1).to_pylist()
                keep = pa.array([not x for x in leaks_in(texts, *held.value)], pa.bool_())
                yield b.filter(keep).select(range(b.num_columns - 1))

        clean = clean.select("*", F.col("text").alias("_leak_text")).mapInArrow(run, docs.schema)
    return clean


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    lean(spark)
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
