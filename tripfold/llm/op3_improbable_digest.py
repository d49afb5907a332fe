"""Document fingerprints: a digest of improbable features.

Every window of WINDOW bytes has an entropy. How often each entropy occurs is counted over the whole
corpus, and a window's rank is the rarity of its entropy: the rarer, the lower. Within each run of NEAR
windows the first of the lowest rank gets a vote; windows with VOTES or more (where none has as many, those
with the most) are the features. They go, in the order of the text, into a chain of Bloom filters of BITS
bits, FEATURES to each. Two digests
are compared filter by filter: the overlap of set bits, less what chance gives, divided by the most
that it can be; each filter of the shorter chain counts with its best partner.

Entropies are found for all windows of a text at once: sliding by a byte changes the sum of c log c over
byte counts c by what one byte more and one less give, and those counts follow from the places at which
each byte occurs. Sums are of integers, so equal windows have equal entropies wherever they stand.

The next document is found by range-partitioning once by doc_id: parts are cut at bounds of the ids, and
the first row of a part also goes to the part before. No task sees more than a part.

Cases: a null text is the empty one; in texts of less than SHORT bytes, too few to choose from, every window
of SMALL bytes is a feature (one padded window in the shortest); texts from SHORT to twice as many bytes have
both kinds, each in filters of its own, so that a text and a cut copy of it always share a kind; an empty text
has no feature, its likeness is 1 to another without features and 0 to the rest; filters of very long texts are
compared in blocks of PAIRS; of a single document the
next is itself; rows with equal ids follow one another by text; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripfold.llm.common import bounds_of, lean, mixed, shuffle_parts

WINDOW, NEAR, VOTES = 32, 32, 8
SHORT, SMALL = 4 * WINDOW, 8  # bytes below which a text is short, and of the windows that are its features, all of them
BITS, FEATURES, HASHES = 2048, 128, 5
LEVELS = 1 << 10  # steps of entropy
PAIRS = 1 << 16  # pairs of filters that are compared at a time, or those of one filter
_G = np.rint(np.r_[0, np.arange(1, WINDOW + 2) * np.log2(np.arange(1, WINDOW + 2))] * (1 << 20)).astype(np.int64)  # c log c
_TOP = int(_G[WINDOW])
_SALTS = np.array([(20 + k) * 0x9E3779B97F4A7C15 & (2**64 - 1) for k in range(HASHES)], np.uint64)  # those of mixed


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy step (0 to LEVELS - 1) of each window of the bytes, from 0 for one repeated byte."""
    n = len(data)
    if n < WINDOW:
        return np.empty(0, np.int64)
    order = np.argsort(data, kind="stable")
    at = order + data[order].astype(np.int64) * (2 * n + 2 * WINDOW)  # places of each byte, kept apart by byte
    place = np.arange(n)
    back, ahead = np.empty(n, np.int64), np.empty(n, np.int64)
    back[order] = place - np.searchsorted(at, at - WINDOW, "left") + 1  # its count in the WINDOW + 1 bytes up to here
    ahead[order] = np.searchsorted(at, at + WINDOW, "right") - place  # and in those from here on
    first = int(_G[np.bincount(data[:WINDOW])].sum())
    step = (_G[back[WINDOW:]] - _G[back[WINDOW:] - 1]) - (_G[ahead[: n - WINDOW]] - _G[ahead[: n - WINDOW] - 1])
    return (_TOP - np.r_[first, first + np.cumsum(step)]) * (LEVELS - 1) // _TOP


def hashed(windows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window, a row of bytes."""
    words = np.ascontiguousarray(windows).view("<u8")
    h = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words.shape[1]):
            h = h * np.uint64(0x9FB21C651E98DF25) + mixed(words[:, k], k + 1)
    return mixed(h, 9)


def chosen(data: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of the windows that are features. rank: of each entropy step, low for rare ones."""
    r = rank[entropies(data)]
    n = len(r)
    key = r * (1 << 32) + np.arange(n)  # the first of equal ranks wins
    near, span = min(NEAR, n), 1
    low = key
    while 2 * span <= near:
        low, span = np.minimum(low[: len(low) - span], low[span:]), 2 * span
    if span < near:
        low = np.minimum(low[: n - near + 1], low[near - span :])
    votes = np.bincount(low & 0xFFFFFFFF, minlength=n)
    return np.flatnonzero(votes >= min(VOTES, votes.max()))


def features(data: np.ndarray, rank: np.ndarray) -> list:
    """64-bit hashes of a text's features, in order: of the windows of WINDOW bytes, and of those of SMALL bytes."""
    out = []
    if len(data) >= SHORT:
        out.append(hashed(data[chosen(data, rank)[:, None] + np.arange(WINDOW)]))
    if 0 < len(data) < 2 * SHORT:
        padded = np.concatenate([data, np.zeros(max(0, SMALL - len(data)), np.uint8)])
        out.append(hashed(padded[np.arange(len(padded) - SMALL + 1)[:, None] + np.arange(SMALL)]))
    return out


def digest(kinds: list) -> np.ndarray:
    """The chain: a row of BITS / 8 bytes for each filter. Each kind of features has its own filters."""
    links = [np.arange(len(h)) // FEATURES for h in kinds]
    begin = np.cumsum([0, *(int(x[-1]) + 1 for x in links)])
    chain = np.zeros((begin[-1], BITS), bool)
    for h, link, at in zip(kinds, links, begin):
        chain[(at + link)[:, None], (mixed(h[:, None] ^ _SALTS) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(chain, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    a, b = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    step, best = max(1, PAIRS // len(b)), []
    for k in range(0, len(a), step):
        both = np.bitwise_count(a[k : k + step, None] & b[None]).sum(2, dtype=np.int64)
        n = na[k : k + step, None]
        most, chance = np.minimum(n, nb[None]), n * nb[None] / BITS
        best.append(np.where(most > chance, (both - chance) / np.maximum(most - chance, 1e-9), both >= most).max(1))
    return float(np.clip(np.concatenate(best), 0, 1).mean())


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def ranks(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy step: how many windows of the corpus have it, as an order."""

    def count(batches):
        total = np.zeros(LEVELS, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                total += np.bincount(entropies(_bytes(text or "")), minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(total)], ["level", "n"])

    n = np.zeros(LEVELS, np.int64)
    for r in docs.select("text").mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        n[r["level"]] = r["n"]  # LEVELS rows
    return np.argsort(np.argsort(n, kind="stable"), kind="stable").astype(np.int64)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """See OUT: fingerprints of every text and of its edited text, and the likeness to that and the next one's."""
    spark = docs.sparkSession
    rank = spark.sparkContext.broadcast(ranks(docs))
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = np.array(bounds_of(given, "doc_id", 4 * shuffle_parts(spark)), np.int64)  # a number for each part

    def part_of(ids: list) -> np.ndarray:
        return np.searchsorted(cuts, np.array([-(2**63) if i is None else i for i in ids], np.int64), "right")

    # the least id of each part; its first row by text also belongs to the part before (of the first part, to the last)
    def least(batches):
        found: dict = {}
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, k in zip(ids, part_of(ids).tolist()):
                at = -(2**63) if i is None else i
                found[k] = min(found.get(k, at), at)
        if found:
            yield pa.RecordBatch.from_pydict({"part": list(found), "id": list(found.values())})

    heads = {r["part"]: r["id"] for r in given.select("doc_id").mapInArrow(least, "part long, id long").groupBy("part").agg(F.min("id").alias("id")).collect()}
    full = sorted(heads)  # parts that have rows
    before = {k: full[n - 1] for n, k in enumerate(full)}
    last = full[-1] if full else 0

    def dealt(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            part = part_of(ids)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part), pa.array(np.zeros(len(ids), bool))], ["doc_id", "text", "part", "after"])
            head = [n for n, (i, k) in enumerate(zip(ids, part.tolist())) if heads[k] == (-(2**63) if i is None else i)]
            if head:
                # sorted behind the rows of the part before
                rows = b.take(pa.array(head))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array([before[k] for k in part[head].tolist()], pa.int64()), pa.array(np.ones(len(head), bool))], ["doc_id", "text", "part", "after"]
                )

    def run(batches):
        held, rows, done = None, [], None

        def fingerprint(text):
            return digest(features(_bytes(text), rank.value))

        def row(x, nxt):
            text, other = x[1], nxt[1]
            edited = text[: len(text) - len(text) // 4] + other[: len(text) // 4]
            theirs = x[2] if edited == text else fingerprint(edited)
            shown = [base64.b64encode(d.tobytes()).decode() for d in (x[2], theirs)]
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return x[0], len(text), sha, *shown, likeness(x[2], theirs), likeness(x[2], nxt[2])

        for b in batches:
            for i, text, k, after in zip(*(c.to_pylist() for c in b.columns)):
                if held is not None and k == held[3]:
                    now = (i, text, held[2] if text == held[1] else fingerprint(text), k)
                    rows.append(row(held, now))
                    held = None if after else now
                elif not after and k != done:
                    held = (i, text, fingerprint(text), k)
                if after:
                    done = k  # more rows of the next part's first id don't count
            while rows:
                part, rows = rows[:2000], rows[2000:]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), TYPES)], NAMES)

    cut = given.mapInArrow(dealt, "doc_id long, text string, part long, after boolean")
    return cut.repartition(max(shuffle_parts(spark), 1), "part").sortWithinPartitions("part", "after", "doc_id", "text").mapInArrow(run, OUT)


NAMES = [x.split()[0] for x in OUT.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def op3_improbable_digest(spark, sf_dir: str) -> DataFrame:
    lean(spark)
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
