"""Token-id files of directly addressable codes.

Ids are split into 8-bit chunks, lowest first. Level k holds the k-th chunk of every id that has one, a
bitmap tells which of them go on to level k + 1, and a rank directory holds the number of set bits
before every RANK bits. The id at a position is found by a look-up per level (chunk, bit, rank); no
block is decoded.

A folder of such files is a Parquet table with a row per segment: its range part, the place of its
first id within the part, the documents and their ends, and the coded ids as one binary value. Segments
hold whole documents, in ascending doc_id order (equal doc_ids: by text). Any store that Spark writes
to will do, and a lost task is written again. Places in the corpus are part bases (one number for each
range part) plus places within the part.

Cases: a null or empty text is its end id alone; repeated rows are documents of their own, one after
the other; a null doc_id comes first and is given as -1; an empty table gives an empty index.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripfold.llm.common import lean, shared_folder, shuffle_parts

END = 1  # id after each document
SEGMENT = 1 << 20  # ids from which a segment ends with its document
RANK = 512  # bits between two entries of a rank directory
WORDS = 400_000  # words whose ids a worker remembers, at most
TEXTS, BYTES = 4_096, 16 << 20  # texts that are encoded together, and their bytes, at most (one text may have more)
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
MAGIC = b"DACS"
MARK = "<|startoftext|>"  # fixed value: a special token of the tokenizer
MARKS = "".join(c for c in string.punctuation if c != "'")
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # fixed rule of byte-level vocabularies:
_OTHER = [b for b in range(256) if b not in _SHOWN]  # bytes that print stand for themselves, the others follow from 256 on
BYTE_CHARS = [chr(b) if b in _SHOWN else chr(256 + _OTHER.index(b)) for b in range(256)]
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint32)


def encoded(ids: np.ndarray) -> bytes:
    """The ids as levels of chunks with bitmaps and rank directories."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) or not levels:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK // 8), np.uint8)])
        ones = _BITS[bits].reshape(-1, RANK // 8).sum(1)
        levels.append(((rest & 255).astype(np.uint8), bits, np.r_[0, np.cumsum(ones)[:-1]].astype(np.uint32) if len(ones) else np.empty(0, np.uint32)))
        rest = rest[more] >> 8
    head = np.array([len(levels), *(len(c) for c, _, _ in levels)], np.uint32)
    return b"".join([MAGIC, head.tobytes(), *(x.tobytes() for level in levels for x in level)])


class Codes:
    """Coded ids: all of them, or any one."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not directly addressable codes")
        n = int(np.frombuffer(data, np.uint32, 1, 4)[0])
        at, self.levels = 8 + 4 * n, []
        for size in np.frombuffer(data, np.uint32, n, 8).tolist():
            blocks = -(-size // RANK)
            self.levels.append((
                np.frombuffer(data, np.uint8, size, at),
                np.frombuffer(data, np.uint8, blocks * RANK // 8, at + size),
                np.frombuffer(data[at + size + blocks * RANK // 8 : at + size + blocks * (RANK // 8 + 4)], np.uint32),
            ))
            at += size + blocks * (RANK // 8 + 4)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        out = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // RANK * RANK // 8
            i = int(ranks[i // RANK] + _BITS[bits[first : i >> 3]].sum() + _BITS[bits[i >> 3] & ((1 << (i & 7)) - 1)])
        return out

    def all(self) -> np.ndarray:
        out = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            ids = chunks.astype(np.uint32)
            ids[more] |= out << 8
            out = ids
        return out


_LOADED: dict = {}


class _Encoder:
    """Ids of texts. A space or line feed always ends a token, so words between them are encoded once each.

    Words are remembered in two generations of up to WORDS / 2: when the younger is full, it becomes the
    older, and words that are used again move back into the younger.
    """

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.young, self.old = Tokenizer.from_str(source), {}, {}
        self.mark, self.model = self.tokenizer.token_to_id(MARK), self.tokenizer.model

    def encode_each(self, words: list):
        """Words and their ids; many words are one call, kept apart by a special token, which always stands alone."""
        plain = []
        for w in words:
            if "<|" in w:
                yield w, np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                plain.append(w)
        for k in range(0, len(plain), 2000):
            part = plain[k : k + 2000]
            ids = np.array(self.tokenizer.encode(MARK.join(part), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            whole, at = ids.tobytes(), [0, *((cuts + 1) * 4).tolist()]
            yield from zip(part, map(whole.__getitem__, map(slice, at, [*(cuts * 4).tolist(), len(whole)])))

    def piece(self, low: str) -> bytes:
        """Ids of one piece (a run of lower-case letters, or of marks), straight from the tokenizer's model."""
        if not low.isascii():
            low = "".join(map(BYTE_CHARS.__getitem__, low.encode()))
        return np.array([t.id for t in self.model.tokenize(low)], "<u4").tobytes()

    def learn(self, words: list) -> None:
        """Sees to it that the younger generation has all the words.

        Letters, then ASCII marks without an apostrophe: two pieces, cut just there by the tokenizer, which
        lower-cases. They skip its general path, which other words take.
        """
        rest, young = [], self.young
        for w in words:
            if (ids := self.old.get(w)) is None:
                base = w.rstrip(MARKS)
                low = base.lower()
                # a capital sigma is lower-cased by its place, and letters that compose aren't as they are
                if not (base.isalpha() and low.isalpha() and (base.isascii() or ("Σ" not in base and unicodedata.is_normalized("NFC", base)))):
                    rest.append(w)
                    continue
                ids = self.piece(low)
                if len(base) < len(w):
                    tail = w[len(base) :]
                    if tail not in young:
                        young[tail] = self.piece(tail)
                    ids += young[tail]
            young[w] = ids
        young.update(self.encode_each(rest))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with its end id, and where each text's ids end.

        Words are numbered by Arrow, so Python meets each distinct word of the texts once.
        """
        split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.young) + len(words) > WORDS // 2:
            self.young, self.old = {}, self.young
        self.young[""] = b""
        self.learn([w for w in words if w not in self.young])
        known = [self.young[w] for w in words]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        table, begin = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size
        word = coded.indices.to_numpy()
        n = size[word]
        before = np.cumsum(n) - n
        total = int(n.sum())
        place = np.arange(total)
        ids = table[np.repeat(begin[word] - before, n) + place] if total else np.empty(0, "<u4")
        first = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        per = np.add.reduceat(n, first) if len(first) else np.empty(0, np.int64)  # a text has a word at least, if an empty one
        out = np.full(total + len(per), END, "<u4")
        out[place + np.repeat(np.arange(len(per)), per)] = ids
        return out, np.cumsum(per + 1)


def _encoder(source: str) -> _Encoder:
    """One for each worker process, kept between its tasks."""
    if source not in _LOADED:
        _LOADED[source] = _Encoder(source)
    return _LOADED[source]


def together(batches):
    """The rows of the batches, dealt anew into batches of up to TEXTS texts and BYTES bytes."""
    held, rows, size = [], 0, 0
    for b in batches:
        if held and (rows + b.num_rows > TEXTS or size + b.nbytes > BYTES):
            yield pa.concat_batches(held)
            held, rows, size = [], 0, 0
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
    if held:
        yield pa.concat_batches(held)


SEGMENTS = "part long, first long, n long, doc_ids binary, ends binary, codes binary"


def write_index(docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> str:
    """Encodes docs (doc_id, text) and writes the segments to path."""
    with open(tokenizer, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())  # a few MB, as large as the vocabulary

    def run(batches):
        encode, part, first = _encoder(source.value), TaskContext.get().partitionId(), 0
        ids, docs, n = [], [], 0

        def done():
            flat, ends = np.concatenate([x for x, _ in ids]), []
            for x, e in ids:
                ends.append(e + (int(ends[-1][-1]) if ends else 0))
            values = [part, first, len(flat), np.concatenate(docs).tobytes(), np.concatenate(ends).astype(np.int64).tobytes(), encoded(flat)]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["part", "first", "n", "doc_ids", "ends", "codes"])

        for rows in together(batches):
            flat, ends = encode(rows.column(1))
            who = rows.column(0).to_numpy().astype(np.int64)
            at = 0
            while at < len(ends):
                # whole documents until the segment has SEGMENT ids
                begin = int(ends[at - 1]) if at else 0
                to = min(len(ends), at + int(np.searchsorted(ends[at:], begin + SEGMENT - n)) + 1)
                ids.append((flat[begin : int(ends[to - 1])], ends[at:to] - begin)), docs.append(who[at:to])
                n += int(ends[to - 1]) - begin
                at = to
                if n >= SEGMENT:
                    yield done()
                    first, ids, docs, n = first + n, [], [], 0
        if ids:
            yield done()

    given = docs.select(F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc_id"), "text")
    (
        given.repartitionByRange(shuffle_parts(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, SEGMENTS).write.option("compression", "zstd").parquet(path)
    )
    return path


def _bases(index: DataFrame) -> dict:
    """Ids before each range part: one number a part."""
    bases, at = {}, 0
    for r in index.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        bases[r["part"]], at = at, at + r["n"]
    return bases


def read_index(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    index = spark.read.schema(SEGMENTS).parquet(path)
    bases = _bases(index)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, ends = Codes(r["codes"]).all().astype("<u4"), np.frombuffer(r["ends"], np.int64)
                starts = np.r_[0, ends[:-1]]
                crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(r["doc_ids"], np.int64)), pa.array(starts + r["first"] + bases[r["part"]]), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return index.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(spark, path: str, places: DataFrame) -> DataFrame:
    """place and id for each row of places(place): joined to its segment, then looked up there alone."""
    index = spark.read.schema(SEGMENTS).parquet(path)
    bases = _bases(index)
    base = F.create_map(*[F.lit(x) for kv in (bases or {0: 0}).items() for x in kv])
    heads = index.select("part", "first", (base[F.col("part")] + F.col("first")).alias("begin"), "n")
    # places meet segments on a grid of SEGMENT ids: a segment covers few cells
    cells = heads.withColumn("cell", F.explode(F.sequence(F.floor(F.col("begin") / SEGMENT), F.floor((F.col("begin") + F.col("n") - 1) / SEGMENT))))
    asked = places.select("place", F.floor(F.col("place") / SEGMENT).alias("cell")).join(cells, "cell").where("place >= begin and place < begin + n")
    asked = asked.groupBy("part", "first").agg(F.collect_set(F.col("place") - F.col("begin")).alias("at"), F.first("begin").alias("begin"))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                codes = Codes(r["codes"])
                yield pa.RecordBatch.from_pydict({"place": [r["begin"] + i for i in r["at"]], "id": [codes[i] for i in r["at"]]})

    found = index.join(asked, ["part", "first"]).select("begin", "at", "codes").mapInArrow(run, "place long, id long")
    return places.join(found, "place").select("place", "id")


def op9_token_index(spark, sf_dir: str) -> DataFrame:
    lean(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_index(spark, write_index(docs, shared_folder(spark)))
