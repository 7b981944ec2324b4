"""Bounded-space online packing of token sequences.

Each partition tokenizes its documents and keeps a fixed number of open windows.  A piece goes
into the open window that it fills best; when none has room, the fullest is closed (its rest is
filled by a cut of the arriving document where that rest is worth a cut) and a fresh one opened.
What is open at a partition's end is merged in a second round, by best fit over whole windows, in
groups of bounded size.  Memory is that of the open windows' piece lists, whatever the input.

Tokens come from the tokenizers library.  Its pre-tokenizer drops white space and never joins
across it, so a text is encoded chunk by chunk between spaces and line feeds, and the ids of
frequent chunks are remembered in a memo of bounded size.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gridtrack.llm.common import kept, parts, rows, scratch, tidy

CAPACITY = 4096
OPEN = 64
CUT = 64  # a closing window's rest from which a document is cut to fill it
MEMO = 300_000
GROUP = 4096  # windows merged together
PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64()), ("open", pa.bool_())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, fill long, open boolean"
SPECIAL = "<|"
WORD_END = "</w>"
TRAILING = ".,;:!?"
JOINED = 400  # runs of letters encoded together


class Memo:
    """A map of bounded size: entries unused for a whole generation are dropped."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def put_all(self, more: dict) -> None:
        """Many at once; a generation may then hold as many more than its bound."""
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young.update(more)

    def get(self, key):
        if (v := self.young.get(key)) is None and (v := self.old.get(key)) is not None:
            self.put(key, v)
        return v


class Encoder:
    """Ids of a text as little-endian 32-bit integers, with the end id.

    Chunks that the memo lacks are cut into letters and trailing punctuation, which the
    pre-tokenizer parts as well; new runs of letters are encoded many at a time, joined by spaces,
    and told apart by their last tokens, which carry the end-of-word mark.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.memo, self.end = Memo(MEMO), end.to_bytes(4, "little")

    def _one_by_one(self, chunks: list[str]) -> Iterator[bytes]:
        for lo in range(0, len(chunks), 10_000):
            for e in self.tokenizer.encode_batch_fast(chunks[lo : lo + 10_000], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()

    def _runs(self, stems: list[str]) -> Iterator[bytes]:
        """Ids of runs of letters."""
        groups = [stems[lo : lo + JOINED] for lo in range(0, len(stems), JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(group) or ends[-1] != len(ids):
                yield from self._one_by_one(group)
                continue
            raw, begin = ids.tobytes(), 0
            for n in (4 * ends).tolist():
                yield raw[begin:n]
                begin = n

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of chunks that the memo lacks, and of the letters and punctuation that they share."""
        get = self.memo.get
        stems: dict[str, bytes | None] = {}
        tails: dict[str, bytes | None] = {}
        split, other = [], []
        for c in chunks:
            if c.isalpha():
                stems[c] = None
            elif (stem := c.rstrip(TRAILING)).isalpha():
                split.append((c, stem, c[len(stem) :]))
            else:
                other.append(c)
        for _, stem, tail in split:
            if stem not in stems:
                stems[stem] = get(stem)
            if tail not in tails:
                tails[tail] = get(tail)
        new = [x for x, v in stems.items() if v is None]
        stems.update(zip(new, self._runs(new), strict=True))
        rest = [*other, *(t for t, v in tails.items() if v is None)]
        known = dict(zip(rest, self._one_by_one(rest), strict=True))
        tails = {t: known[t] if v is None else v for t, v in tails.items()}
        known.update(stems)
        for c, stem, tail in split:
            known[c] = stems[stem] + tails[tail]
        self.memo.put_all({c: v for c, v in known.items() if len(c) <= 64})
        return known

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """One text after the other.  Texts that spell a special token are encoded whole."""
        split = [None if SPECIAL in t else t.replace("\n", " ").split(" ") for t in texts]
        chunks = list(chain.from_iterable(x for x in split if x))
        found = list(map(self.memo.young.get, chunks))
        lacking = [i for i, v in enumerate(found) if v is None]
        if lacking:
            get = self.memo.get
            known = {c: b"" if not c else get(c) for c in {chunks[i] for i in lacking}}
            known.update(self._learn([c for c, v in known.items() if v is None]))
            for i in lacking:
                found[i] = known[chunks[i]]
        at = 0
        for t, own in zip(texts, split, strict=True):
            if own is None:
                yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() + self.end
            else:
                yield b"".join(found[at : at + len(own)]) + self.end
                at += len(own)


class Packer:
    """The open windows of one partition."""

    def __init__(self, capacity: int, most: int, cut: int):
        self.capacity, self.most, self.cut = capacity, most, cut
        self.rest: list[tuple[int, int]] = []  # sorted (free, window)
        self.pieces: dict[int, list] = {}
        self.made = 0

    def _new(self) -> tuple[int, int]:
        self.made += 1
        self.pieces[self.made] = []
        return self.capacity, self.made

    def _put(self, at: tuple[int, int], piece: tuple, n: int) -> Iterator[tuple[int, list, int]]:
        free, w = at
        self.pieces[w].append((piece, self.capacity - free))
        if free == n:
            yield w, self.pieces.pop(w), self.capacity
        else:
            insort(self.rest, (free - n, w))

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple[int, list, int]]:
        """Place one document; yields the windows that this closes as (window, pieces, fill)."""
        total, start = len(ids) // 4, 0

        def piece(n: int) -> tuple:
            return doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total

        while start < total:
            n = total - start
            if n >= self.capacity:
                yield from self._put(self._new(), piece(self.capacity), self.capacity)
                start += self.capacity
                continue
            at = bisect_left(self.rest, (n, -1))
            if at < len(self.rest):
                yield from self._put(self.rest.pop(at), piece(n), n)
                return
            if len(self.rest) >= self.most:
                free, w = self.rest.pop(0)
                if free >= self.cut:
                    yield from self._put((free, w), piece(free), free)
                    start += free
                else:
                    yield w, self.pieces.pop(w), self.capacity - free
                continue
            yield from self._put(self._new(), piece(n), n)
            return

    def close(self) -> Iterator[tuple[int, list, int]]:
        for free, w in self.rest:
            yield w, self.pieces[w], self.capacity - free
        self.rest, self.pieces = [], {}


def merge(fills: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best fit, fullest first: for each window its merged window and its offset there."""
    to, offset = np.zeros(len(fills), np.int64), np.zeros(len(fills), np.int64)
    rest: list[tuple[int, int]] = []
    made = 0
    for i in np.argsort(-fills, kind="stable").tolist():
        n = int(fills[i])
        at = bisect_left(rest, (n, -1))
        if at < len(rest):
            free, w = rest.pop(at)
        else:
            free, w, made = capacity, made, made + 1
        to[i], offset[i] = w, capacity - free
        if free > n:
            insort(rest, (free - n, w))
    return to, offset


def pack(docs: DataFrame, path: str, end: int, capacity: int = CAPACITY, most_open: int = OPEN, cut: int = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.

    Every document (null text: empty) yields its ids and the end id, each in exactly one piece.
    Sequences hold at most ``capacity`` ids; sequence ids are unique, not consecutive.  Null ids
    are kept as null.  An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = kept(("encoder", path, end), lambda: Encoder(path, end)), Packer(capacity, most_open, cut)
        base = TaskContext.get().partitionId() << 32
        columns, flush = rows(PIECE)

        def write(windows: Iterator[tuple[int, list, int]], open_: bool) -> None:
            for w, pieces, fill in windows:
                for p, offset in pieces:
                    for c, v in zip(columns, (*p, base + w, offset, fill, open_), strict=True):
                        c.append(v)

        for b in batches:
            for lo, hi in parts(b.column(1), 1 << 20):
                ids = b.column(0)[lo:hi].to_pylist()
                texts = [t or "" for t in b.column(1)[lo:hi].to_pylist()]
                for doc_id, own in zip(ids, encoder.ids(texts), strict=True):
                    write(packer.add(doc_id, own), False)
                yield from flush()
        write(packer.close(), True)
        yield from flush()

    def again(key: tuple, windows: pa.Table) -> pa.Table:
        to, offset = merge(windows.column("fill").to_numpy(), capacity)
        ids = (1 << 62) + (int(key[0].as_py()) << 32) + to
        return pa.table({"old": windows.column("old"), "new": pa.array(ids), "shift": pa.array(offset)})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = scratch.table(texts.mapInArrow(tidy(run, keep=True), DDL), "pieces")
    left = pieces.where("open").select(F.col("sequence_id").alias("old"), "fill").distinct()
    groups = -(-left.count() // GROUP)
    merged = left.withColumn("g", F.pmod(F.xxhash64("old"), F.lit(max(1, groups)))).groupBy("g").applyInArrow(again, "old long, new long, shift long")
    last = pieces.where("open").join(merged, F.col("sequence_id") == F.col("old"))
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return pieces.where("not open").select(*keep, "sequence_id", "offset").unionByName(last.select(*keep, F.col("new").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset")))
