"""N-gram Jaccard join by prefix filtering under several global token orders.

Two shingle sets of similarity t or more share a token among the first n - ceil(t n) + 1 of each, n
being the set's size, under whichever order all sets are sorted by. The first order puts tokens of one
set before tokens of several, as counted over the whole corpus; to keep that count small it ranks
tokens by a hash and counts only those in its lowest part (twice as large as a prefix), which is a
global order all the same. Sets whose prefix holds no shared token have no partner. The others are
grouped by leader: the smallest set of each prefix token's list. Any two sets that share a prefix token
are in one leader's group. A group is cut into blocks of bounded size, and every pair of blocks is one
unit of work. In it, only pairs that also share a prefix token under each of the ORDERS further orders
are verified, exactly, and pairs that are connected already are skipped; what leaves it is a spanning
forest, never all pairs. Texts with equal sets are one set from the start.

Tokens and sets are known by 64-bit hashes (two unequal sets of one size count as equal with
probability 2**-64).

Cases: null and empty texts, or texts without words, have n_shingles 0 and are linked with nothing;
texts shorter than a shingle have their whole word sequence as one; repeated rows are copies; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tripfold.llm.common import MARKS, lean, mixed, shingle_hashes, stored, with_marks
from tripfold.llm.components import components

ORDERS = 2  # further orders, besides the one by rarity
BLOCK = 1_000_000  # tokens of a block
SIEVE = 1 << 28  # bits of a sieve that tells which tokens or sets matter, at most
SEED = 1


def needed(n, percent: int):
    """How many of its n tokens a set shares, at least, with a set of that similarity."""
    return -(-percent * n // 100)


def _sets(text, words: int) -> tuple[np.ndarray, int]:
    s = shingle_hashes(text, words)
    return s, (int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), len(s))).view(np.int64)) if len(s) else 0)


def documents_and_tokens(docs: DataFrame, words: int, percent: int, marks: tuple = ()) -> DataFrame:
    """doc_id, n_shingles, set_id, n_low, low and the long columns `marks` for each row; low: the tokens that may be in the set's
    prefix (null where this task has given them for an equal set before)."""
    limit = np.uint64(int(2**64 * 2 * (100 - percent) / 100) if percent > 50 else 2**64 - 1)

    def run(batches):
        seen = set()
        for b in batches:
            ids, ns, keys, counts, lows = b.column(0), [], [], [], []
            for text in b.column(1).to_pylist():
                s, key = _sets(text, words)
                n, low, count = len(s), None, 0
                if n:
                    rank = mixed(s, SEED)
                    prefix = n - needed(n, percent) + 1
                    count = max(int((rank < limit).sum()), prefix)
                    if key not in seen:
                        seen.add(key)
                        low = s[np.argpartition(rank, count - 1)[:count]].view(np.int64)
                ns.append(n), keys.append(key), counts.append(count), lows.append(low)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(ns, pa.int64()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(lows, pa.list_(pa.int64())), *b.columns[2:]],
                ["doc_id", "n_shingles", "set_id", "n_low", "low", *marks],
            )

    return docs.select("doc_id", "text", *marks).mapInArrow(run, ", ".join(["doc_id long, n_shingles long, set_id long, n_low long, low array<long>", *(f"{m} long" for m in marks)]))


def sieve(ids: DataFrame):
    """A broadcast bit map in which the bits of the ids (one long column) are set: 8 bits an id, SIEVE at most.

    What it lets through is joined to the ids afterwards, so it only spares the rest a shuffle; at its
    largest it lets more through, and results stay the same.
    """
    n, bits = ids.count(), 1 << 10
    while bits < min(SIEVE, 8 * n):
        bits *= 2

    def mark(batches):
        out = np.zeros(bits // 8, np.uint8)
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(bits - 1)
            np.bitwise_or.at(out, (x >> np.uint64(3)).astype(np.int64), np.uint8(1) << (x & np.uint64(7)).astype(np.uint8))
        step = 1 << 16
        for k in range(0, len(out), step):
            yield pa.RecordBatch.from_pydict({"at": [k], "part": [out[k : k + step].tobytes()]})

    def merged(batches):
        parts: dict = {}
        for b in batches:
            for at, part in zip(*(c.to_pylist() for c in b.columns)):
                part = np.frombuffer(part, np.uint8)
                parts[at] = parts[at] | part if at in parts else part
        for at, part in parts.items():
            yield pa.RecordBatch.from_pydict({"at": [at], "part": [part.tobytes()]})

    # SIEVE / 8 bytes at most, from each of a few tasks and then to the driver
    whole, schema = np.zeros(bits // 8, np.uint8), "at long, part binary"
    for r in ids.coalesce(8).mapInArrow(mark, schema).repartition(8, "at").mapInArrow(merged, schema).toLocalIterator():
        part = np.frombuffer(r["part"], np.uint8)
        whole[r["at"] : r["at"] + len(part)] |= part
    return ids.sparkSession.sparkContext.broadcast(whole)


def passes(held: np.ndarray, ids: np.ndarray) -> np.ndarray:
    x = ids.view(np.uint64) & np.uint64(8 * len(held) - 1)
    return (held[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def leaders(tokens: DataFrame, percent: int) -> DataFrame:
    """leader, set_id and n, the set's size: the groups in which the sets' partners are."""
    given = tokens.where("low is not null").select("set_id", "n_shingles", "n_low", "low")
    # a token of one set has lo = hi; both are combined before the shuffle
    shared = stored(
        given.select("set_id", F.explode("low").alias("token"))
        .groupBy("token").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi"), F.count("*").alias("df"))
        .where("lo <> hi").select("token", "df")
    )
    held = sieve(shared.select("token"))

    def some(batches):
        for b in batches:
            low = b.column(3)
            token, n = low.flatten().to_numpy(zero_copy_only=False), np.diff(low.offsets.to_numpy())
            keep = passes(held.value, token)
            row = np.repeat(np.arange(b.num_rows), n)[keep]
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), b.column(2).take(row), pa.array(token[keep])], ["set_id", "n", "n_low", "token"])

    kept = given.mapInArrow(some, "set_id long, n long, n_low long, token long").join(shared, "token").distinct()
    mine = Window.partitionBy("set_id")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100).cast("decimal(3,0)")) + 1
    ranked = stored(
        kept.withColumn("_at", F.row_number().over(mine.orderBy("df", "token"))).withColumn("_shared", F.count("*").over(mine))
        .where(F.col("_at") <= prefix - (F.col("n_low") - F.col("_shared"))).select("token", "set_id", "n")
    )
    first = ranked.groupBy("token").agg(F.min("set_id").alias("leader"), F.max("set_id").alias("hi")).where("leader <> hi").select("token", "leader")
    return stored(ranked.join(first, "token").select("leader", "set_id", "n").distinct())


def sets_of(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """set_id and tokens (sorted 64-bit little-endian) of the given sets, shingled again from their texts.

    A sieve spares the other sets' tokens a shuffle; the join to members drops what it lets through.
    """
    held = sieve(members.select("set_id").distinct())

    def run(batches):
        seen = set()
        for b in batches:
            keys, sets = [], []
            for text in b.column(0).to_pylist():
                s, key = _sets(text, words)
                if len(s) and key not in seen and passes(held.value, np.array([key]))[0]:
                    seen.add(key), keys.append(key), sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["set_id", "tokens"])

    return docs.select("text").mapInArrow(run, "set_id long, tokens binary").dropDuplicates(["set_id"])


def links_within(ids: np.ndarray, sets: list, side: np.ndarray, percent: int) -> list:
    """Links (id, id) that connect what is connected among the sets; if there are two sides, pairs of one side don't count."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, sets, side = ids[order], [sets[i] for i in order], side[order]
    n = np.array([len(s) for s in sets])
    two = side.min() != side.max()
    first = np.r_[0, np.cumsum(n)]
    whole = np.concatenate(sets)
    indexes = []
    for k in range(ORDERS):
        take = n - needed(n, percent) + 1
        prefixes = [s[np.argpartition(mixed(s, SEED + 1 + k), p - 1)[:p]] for s, p in zip(sets, take)]
        tokens, owner = np.concatenate(prefixes), np.repeat(np.arange(len(sets)), take)
        by = np.argsort(tokens, kind="stable")
        indexes.append((prefixes, tokens[by], owner[by]))
    label, found = np.arange(len(sets)), []

    def join(x: int, ys: np.ndarray) -> None:
        """Verifies x against each y and joins their labels where they link."""
        if not len(ys):
            return
        size = n[ys]
        at = np.repeat(first[ys] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        tokens = whole[at]
        pos = np.minimum(np.searchsorted(sets[x], tokens), n[x] - 1)
        both = np.add.reduceat((sets[x][pos] == tokens).astype(np.int64), np.r_[0, np.cumsum(size)[:-1]])
        for y in ys[100 * both >= percent * (n[x] + size - both)]:
            if label[y] != label[x]:
                found.append((int(ids[x]), int(ids[y])))
                label[label == label[y]] = label[x]

    def partners(x: int) -> np.ndarray:
        ok = None
        for prefixes, tokens, owner in indexes:
            lo, hi = np.searchsorted(tokens, prefixes[x], "left"), np.searchsorted(tokens, prefixes[x], "right")
            hit = np.zeros(len(sets), bool)
            for a, b in zip(lo, hi):
                hit[owner[a:b]] = True
            ok = hit if ok is None else ok & hit
        ok &= (needed(n, percent) <= n[x]) & (n >= needed(n[x], percent)) & (label != label[x])
        if two:
            ok &= side != side[x]
        return np.flatnonzero(ok)

    # what is connected to the set of middle size needn't look for partners: of two sets that link, the one that
    # isn't connected to it at its turn has looked, and if both are, they are in one component
    middle = len(sets) // 2
    for x in [middle, *range(len(sets))]:
        if x == middle or label[x] != label[middle]:
            join(x, partners(x))
    return found


SMALL = 1_000_000  # rows of a few numbers that may be broadcast


def held(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if there are few, else joined by shuffle."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets. members: leader, set_id, n; sets: set_id, tokens.

    Groups of more than BLOCK tokens, of which there are few, are cut first, by ids alone; a set's tokens
    then go to each pair of blocks that it is in.
    """
    large = members.groupBy("leader").agg(F.sum("n").alias("_size")).where(F.col("_size") > BLOCK)
    large = stored(large.withColumn("blocks", F.ceil(F.col("_size") / BLOCK).cast("long")).select("leader", "blocks"))
    cut = (
        members.join(held(large), "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        .withColumn("block", F.pmod(F.xxhash64("set_id"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("leader", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "set_id")
        .join(sets, "set_id")
    )

    def run(batches):
        key, ids, sets, side = None, [], [], []

        def done():
            if len(ids) > 1:
                out = links_within(np.array(ids), sets, np.array(side), percent)
                if out:
                    yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]})

        for b in batches:
            for r in b.to_pylist():
                k = r["leader"], r["x"], r["y"]
                if k != key:
                    yield from done()
                    key, ids, sets, side = k, [], [], []
                ids.append(r["set_id"]), sets.append(np.frombuffer(r["tokens"], np.uint64)), side.append(r["block"])
        yield from done()

    return cut.repartition("leader", "x", "y").sortWithinPartitions("leader", "x", "y", "set_id").mapInArrow(run, "a long, b long")


def least_of_sets(docs: DataFrame, tokens: DataFrame, words: int, percent: int, value) -> DataFrame:
    """_set and least: the least value (a column of tokens) among the rows of a set's component."""
    members = leaders(tokens, percent)
    classes = components(stored(links(members, sets_of(docs, members, words), percent)))
    ids = tokens.where("n_shingles > 0").groupBy("set_id").agg(F.min(value).alias("first"))
    classed = ids.join(classes, ids["set_id"] == classes["node"], "left").select("set_id", "first", F.coalesce("component", "set_id").alias("class"))
    least = classed.groupBy("class").agg(F.min("first").alias("least"))
    return classed.join(least, "class").select(F.col("set_id").alias("_set"), "least")


def ngram_jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id per row: components of the links whose similarity is percent/100 or more."""
    tokens = stored(documents_and_tokens(docs, words, percent))
    of_set = least_of_sets(docs, tokens, words, percent, F.col("doc_id"))
    out = tokens.select("doc_id", "n_shingles", "set_id")
    return (
        out.join(of_set, (out["set_id"] == of_set["_set"]) & (out["n_shingles"] > 0), "left")
        .select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the smallest doc_id stays (null
    after all others; of several, the one with the least hash of all its columns; of equal rows, one). Rows
    without words stay. Rows are told apart by that hash (128 bits), so ids may be null or repeated."""
    marked = with_marks(docs)
    tokens = stored(documents_and_tokens(marked, words, percent, MARKS))
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", *MARKS)
    of_set = least_of_sets(docs, tokens, words, percent, first)
    rows = tokens.where("n_shingles > 0").select("set_id", *MARKS)
    rows = rows.join(of_set, rows["set_id"] == of_set["_set"])
    first_ones = " and ".join(f"{m} = least.{m}" for m in MARKS)
    drop = stored(rows.where(f"not ({first_ones})").select(*MARKS).distinct())
    equal = stored(rows.where(first_ones).groupBy(*MARKS).count().where("count > 1").select(*MARKS))

    kept = marked.join(held(drop), [*MARKS], "left_anti")
    if not equal.isEmpty():
        again = held(equal)
        once = kept.join(again, [*MARKS], "left_semi").dropDuplicates([*MARKS])
        kept = kept.join(again, [*MARKS], "left_anti").unionByName(once)
    return kept.select(docs.columns)


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    lean(spark)
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85)
