"""Spelling variant grouping: words that differ by one code point, found in a frequency-vector trie.

A word's letters fall into GROUPS groups, and its vector holds how many letters of each group it has. The
trie arranges the words by length and then by the count of one group after the other. One inserted code
point is a surplus of one in one group; a replaced one is a surplus and a deficit, or neither if both
letters are of one group. So a word's near words lie at leaves that a search reaches which may spend one
surplus and one deficit on its way down, and the words at those leaves are compared letter by letter.

Each pair is met once: from the shorter word if lengths differ, else from the one whose vector is exceeded
in the first group that differs (pairs with equal vectors are met from both sides).

The top of the trie (length and the first groups, one more for every fourfold vocabulary) is a join: a word
goes to the existing tops that its budget reaches. Below, a task builds the trie of a block of words of one
top and searches depth-first, in pieces of bounded size. A top with many words is several blocks, chosen by
hash, and its searches visit them all, so no block exceeds BLOCK words or BYTES bytes and no pair is lost.

Cases: a null text has no words; a null doc_id counts as empty text where the id is hashed; repeated rows
count again; a table without words gives no rows. A form has at least FORM_TIMES times a word's
occurrences, so chains of forms can't run in circles.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripfold.llm.common import lean, shuffle_parts, stored

LETTERS, TIMES = 6, 5  # code points and occurrences of a word, at least
FORM_TIMES = 5  # a form's occurrences for each of the word's, at least
SPOILT = 199  # occurrences whose hash this divides lose a code point
GROUPS, TOP = 24, 3  # letter groups; of these, at the top of the trie up to DENSE words
DENSE = 1_000_000
BLOCK, BYTES = 1 << 15, 1 << 22  # words and bytes of a block, at most
SEARCHES, STATES, PAIRS = 1 << 13, 1 << 17, 1 << 19  # handled at a time
COUNTS = 400_000  # words that a counting task holds before it passes them on
_RUNS = re.compile(f"[A-Za-zÀ-ÿ]{{{LETTERS},}}")  # greedy: whole runs


def words_in(doc_id, text: str | None) -> Counter:
    """How often each word of at least LETTERS code points occurs in a text.

    A run's A-Z are lower-cased. Let h be the crc32 of "<doc_id>:<run>": if SPOILT divides h, the run loses
    its code point h modulo length.
    """
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    runs = Counter(_RUNS.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))  # bytes know only A-Z
    spoilt = [(w, h) for w in runs if (h := zlib.crc32(w.encode(), seed)) % SPOILT == 0]
    cut = [(w[: h % len(w)] + w[h % len(w) + 1 :], runs.pop(w)) for w, h in spoilt]
    for w, n in cut:
        if len(w) >= LETTERS:
            runs[w] += n
    return runs


def occurrences(docs: DataFrame) -> DataFrame:
    """word and n: how often each word occurs in the texts, if at least TIMES."""

    def run(batches):
        have: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(have), pa.string()), pa.array(list(have.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                have.update(words_in(doc_id, text))
                if len(have) > COUNTS:
                    yield out()
                    have = Counter()
        if have:
            yield out()

    words = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


def letter_groups(words: DataFrame) -> list[str]:
    """The letters of each group: the most frequent letters are alone, the rest share groups in turn."""
    rows = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n")).where("c <> ''").collect()  # 90 at most
    ranked = [r["c"] for r in sorted(rows, key=lambda r: (-r["n"], r["c"]))]
    return ["".join(ranked[g::GROUPS]) for g in range(GROUPS)]


def top_groups(n_words: int) -> int:
    return min(GROUPS, TOP + max(0, math.ceil(math.log(max(n_words, 1) / DENSE, 4))))


def searches(counts: list[Column]) -> Column:
    """The tops that a word's budget reaches: key, and the surplus and deficit left below."""
    length = F.length("word")

    def top(longer: int, up: int | None, down: int | None, surplus: int, deficit: int) -> Column:
        at = [c + 1 if g == up else c - 1 if g == down else c for g, c in enumerate(counts)]
        found = F.struct(F.concat_ws(".", length + longer, *at).alias("key"), F.lit(surplus).alias("surplus"), F.lit(deficit).alias("deficit"))
        return found if down is None else F.when(counts[down] > 0, found)

    some = range(len(counts))
    same = [top(0, None, None, 1, 1), *(top(0, g, None, 0, 1) for g in some), *(top(0, g, k, 0, 0) for g in some for k in some if g < k)]
    return F.explode(F.array_compact(F.array(*same, top(1, None, None, 1, 0), *(top(1, g, None, 0, 0) for g in some))))


class Trie:
    """The vectors of some words of one length as a trie, from group `top` on; the groups before are alike."""

    def __init__(self, words: list, group: np.ndarray, top: int):
        self.letters = matrix(words)
        vectors = vectors_of(self.letters, group)
        order = np.lexsort(vectors.T[::-1])
        self.order, vectors, self.top = order, vectors[order], top
        self.letters = self.letters[order]
        self.width = self.letters.shape[1] + 2
        new = np.ones(len(order), bool)
        new[1:] = False
        parent, self.edges = np.zeros(len(order), np.int64), []
        for g in range(top, GROUPS):
            new[1:] |= vectors[1:, g] != vectors[:-1, g]
            self.edges.append((parent * self.width + vectors[:, g])[new])  # ascending; the child's number is the place
            parent = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.r_[self.first, len(order)])

    def leaves(self, vectors: np.ndarray, surplus: np.ndarray, deficit: np.ndarray):
        """Depth-first: yields (search, leaf, surplus left), piece by piece. A deficit is spent after the surplus."""
        stack = [(self.top, np.arange(len(vectors)), np.zeros(len(vectors), np.int64), surplus, deficit)]
        while stack:
            g, q, node, s, d = stack.pop()
            if g == GROUPS:
                yield q, node, s
                continue
            count, edges, found = vectors[q, g], self.edges[g - self.top], []
            for change, may in ((0, slice(None)), (1, np.flatnonzero(s == 1)), (-1, np.flatnonzero((s == 0) & (d == 1) & (count > 0)))):
                want = node[may] * self.width + count[may] + change
                at = np.minimum(np.searchsorted(edges, want), len(edges) - 1)
                hit = edges[at] == want
                found.append((q[may][hit], at[hit], s[may][hit] - (change > 0), d[may][hit] - (change < 0)))
            q, node, s, d = (np.concatenate(x) for x in zip(*found))
            for k in range(0, len(q), STATES):
                stack.append((g + 1, q[k : k + STATES], node[k : k + STATES], s[k : k + STATES], d[k : k + STATES]))

    def near(self, words: list, group: np.ndarray, surplus: np.ndarray, deficit: np.ndarray):
        """Yields (search, word of the trie, whether the pair is met from both sides) of words one edit apart.
        The words searched for are of one length: that of the trie's words, or one less."""
        given = matrix(words)
        same = given.shape[1] == self.letters.shape[1]
        for q, leaf, left in self.leaves(vectors_of(given, group), surplus, deficit):
            many = self.size[leaf]
            upto = np.cumsum(many)
            cuts = np.searchsorted(upto, np.arange(PAIRS, int(upto[-1]) if len(upto) else 0, PAIRS), "right")
            for part in np.split(np.arange(len(q)), cuts):
                if not len(part):
                    continue
                m = many[part]
                a = np.repeat(q[part], m)
                b = np.repeat(self.first[leaf[part]] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(int(m.sum()))
                x, y = given[a], self.letters[b]
                if same:
                    ok = (x != y).sum(1) == 1
                else:
                    head = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(1)
                    tail = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(1)
                    ok = head + tail >= x.shape[1]
                ok = np.flatnonzero(ok)
                yield a[ok], self.order[b[ok]], np.repeat(left[part] == 1, m)[ok] & same


def matrix(words: list) -> np.ndarray:
    """A row of letters for each of some words of one length; every letter of a word is below U+0100."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), len(words[0]))


def vectors_of(letters: np.ndarray, group: np.ndarray) -> np.ndarray:
    n = len(letters)
    at = group[letters].astype(np.int64) + np.arange(n)[:, None] * GROUPS
    return np.bincount(at.ravel(), minlength=n * GROUPS).reshape(n, GROUPS)


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near and n of near for each ordered pair of words that differ by one code point."""
    spark = words.sparkSession
    letters, top = letter_groups(words), top_groups(words.count())
    group = np.zeros(256, np.uint8)
    for g, some in enumerate(letters):
        for c in some:
            group[ord(c)] = g
    counts = [F.length("word") - F.length(F.translate("word", some, "")) if some else F.lit(0) for some in letters[:top]]
    keyed = words.select("word", "n", F.concat_ws(".", F.length("word"), *counts).alias("key"))
    # a row for each top; as many blocks as its words and letters need
    tops = keyed.groupBy("key").agg(F.count("*").alias("_words"), F.sum(F.length("word")).alias("_bytes"))
    tops = stored(tops.select("key", F.greatest(F.ceil(F.col("_words") / BLOCK), F.ceil(F.col("_bytes") / BYTES), F.lit(1)).cast("int").alias("_blocks")))
    block = lambda k: F.concat_ws("/", "key", k).alias("block")
    own = keyed.join(tops, "key").select(block(F.pmod(F.xxhash64("word"), "_blocks")), F.lit(0).alias("kind"), "word", "n", F.lit(0).alias("surplus"), F.lit(0).alias("deficit"))
    looked = words.select("word", "n", searches(counts).alias("_s")).select("word", "n", "_s.*").join(tops, "key")
    looked = looked.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(block("_k"), F.lit(1).alias("kind"), "word", "n", "surplus", "deficit")

    def found(trie, held, waiting):
        """Pairs of the words searched for with those of a block."""
        rows = pa.Table.from_batches(waiting)
        words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        surplus, deficit = (rows.column(c).to_numpy() for c in ("surplus", "deficit"))
        long = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(long):
            pick = np.flatnonzero(long == size)
            text = [words[i] for i in pick]
            mine, own_n = pa.array(text), n[pick]
            for a, b, both in trie.near(text, group, surplus[pick], deficit[pick]):
                yield pa.RecordBatch.from_arrays([mine.take(pa.array(a)), held[0].take(pa.array(b)), pa.array(held[1][b])], ["word", "near", "near_n"])
                back = ~both
                yield pa.RecordBatch.from_arrays([held[0].take(pa.array(b[back])), mine.take(pa.array(a[back])), pa.array(own_n[a[back]])], ["word", "near", "near_n"])

    def run(batches):
        name, trie, held, own, waiting, n = None, None, None, [], [], 0

        def flush():
            nonlocal trie, held, waiting, n
            if waiting and own:
                if trie is None:
                    rows = pa.Table.from_batches(own)
                    held = rows.column("word").combine_chunks(), rows.column("n").to_numpy()
                    trie = Trie(held[0].to_pylist(), group, top)
                yield from found(trie, held, waiting)
            waiting, n = [], 0

        for b in batches:
            key, kind = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, len(key)]):
                if i == j:
                    continue
                if key[i] != name:
                    yield from flush()
                    name, trie, own = key[i], None, []
                if kind[i] == 0:
                    own.append(b.slice(i, j - i))
                    continue
                waiting.append(b.slice(i, j - i))
                n += j - i
                if n >= SEARCHES:
                    yield from flush()
        yield from flush()

    dealt = own.unionByName(looked).repartition(max(shuffle_parts(spark), 1), "block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word and root for each word with a form: forms are followed to the last, twice as far in each round."""
    links = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        step = links.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        links = stored(links.join(step, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if links.where("_moved").isEmpty():
            return links.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root for each word of the texts."""
    words = stored(occurrences(docs))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))  # the largest n, then the first in code-point order
    near = near_pairs(words).groupBy(F.col("word").alias("_word")).agg(F.count("*").alias("n_near"), best.alias("_best"))
    good = -F.col("_best.n") >= FORM_TIMES * F.col("n")
    formed = stored(
        words.join(near, F.col("word") == F.col("_word"), "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("_best.near")).alias("form"), F.when(good, -F.col("_best.n")).alias("form_n"))
    )
    last = roots(formed.where("form is not null")).withColumnRenamed("word", "_word")
    return formed.join(last, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    lean(spark)
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
