"""Byte-level BPE by a bounded-lookahead streaming transducer, and its inverse.

A word's BPE tokens can be found from left to right: for each prefix there is one last token, and
the tokens of the prefix are found by walking back through those last tokens.  A last token t of
the prefix ending at i is right iff it stands next to the last token of the prefix that it leaves
over in the encoding of the two alone (:meth:`Merges.adjacent`, which takes the merges of both back,
the last first, and asks whether one across their border would have come earlier).  A token
can be no longer than the longest in the vocabulary, so whatever comes later leans on one of the
last ``lookahead`` prefixes; a token that all of those share is final and is emitted.  Memory is
that window, however long the word.  The lookahead is computed from the merge list.

Words come from the byte-level pre-tokenizer's public pattern; the tokens of frequent words are
kept in a memo of bounded size.  Decoding maps ids to bytes and feeds an incremental UTF-8 state
machine, which holds back an unfinished character between two feeds and writes U+FFFD for bytes
that can't be text.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from gridtrack.llm.common import parts, rows
from gridtrack.llm.packing import Memo

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 250_000
PAIRS = 600_000
FEED = 256  # bytes the transducer is fed at once
WHOLE = 65_536  # characters from which a text goes through in parts
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merge list of a byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(Tokenizer.from_file(path).to_str())
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.id = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for n, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault((raw(a), raw(b)), n)
        # only tokens that the merges can build appear in an encoding
        self.token = {t: i for t, i in self.id.items() if len(t) == 1}
        self.made: dict[int, int] = {i: -1 for i in self.token.values()}  # rank of the merge that makes a token
        self.split: dict[int, tuple[int, int]] = {}  # and what it merges
        for t in sorted((t for t in self.id if len(t) > 1), key=len):
            last, out = self._last(t)
            if len(out) == 1:
                i = self.token[t] = self.id[t]
                self.made[i], self.split[i] = self.rank[last], (self.id[last[0]], self.id[last[1]])
        self.pairs = {(self.id[a], self.id[b]): n for (a, b), n in self.rank.items() if a in self.id and b in self.id}
        self.size = {i: len(t) for t, i in self.token.items()}
        #: Sufficient lookahead in bytes: no later token reaches further back than the longest token.
        self.lookahead = max(self.size.values())
        #: The longest token by its last three bytes (or its all, if it has fewer).
        self.reach: dict[bytes, int] = {}
        for t in self.token:
            self.reach[t[-3:]] = max(self.reach.get(t[-3:], 0), len(t))
        self.known: dict[int, bool] = {}
        self.bytes = {i: t for t, i in self.id.items()} | {i: t.encode() for t, i in self.special.items()}

    def _last(self, word: bytes) -> tuple[tuple[bytes, bytes] | None, list[bytes]]:
        """The merge list applied as it is defined, lowest rank first, leftmost first: the last merge, and the tokens."""
        out = [word[i : i + 1] for i in range(len(word))]
        rank, last = self.rank, None
        while len(out) > 1:
            best = min((rank.get(p, 1 << 60), i) for i, p in enumerate(zip(out, out[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            last = out[i], out[i + 1]
            out[i : i + 2] = [out[i] + out[i + 1]]
        return last, out

    def merge(self, word: bytes) -> list[bytes]:
        return self._last(word)[1]

    def adjacent(self, a: int, b: int) -> bool:
        """Whether the tokens a and b can stand next to each other: the encoding of both is a, b.

        ``a`` and ``b`` become what touches the border at ever earlier times; ``until`` is when one
        of them was merged away from the border.  Of equal ranks the left merge comes first.
        """
        pairs, made, split, until = self.pairs, self.made, self.split, 1 << 60
        while True:
            if (r := pairs.get((a, b))) is not None and r < until:
                return False
            if made[a] > made[b]:
                until, a = made[a], split[a][1]
            elif b in split:
                until, b = made[b] + 1, split[b][0]
            else:
                return True


class Transducer:
    """Streams the bytes of one word; :meth:`feed` and :meth:`end` yield the ids of tokens that are final."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.window = b""
        self.last: list[int | None] = [None]  # the last token of each prefix of the window

    def _extend(self) -> None:
        token, reach, window, last = self.m.token.get, self.m.reach.get, self.window, self.last
        known, adjacent = self.m.known, self.m.adjacent
        if len(known) > PAIRS:
            known.clear()
        for end in range(len(last), len(window) + 1):
            far = max(reach(window[max(end - 3, 0) : end], 0), 2)  # tokens of one or two bytes are tried anyway
            for at in range(end - far if end > far else 0, end):
                if (t := token(window[at:end])) is not None:
                    before = last[at]
                    if before is not None:
                        key = before << 32 | t
                        if (fits := known.get(key)) is None:
                            fits = known[key] = adjacent(before, t)
                        if not fits:
                            continue
                    last.append(t)
                    break

    def _path(self, end: int) -> list[int]:
        out, last, size = [], self.last, self.m.size
        while end > 0:
            t = last[end]
            out.append(t)
            end -= size[t]
        return out[::-1]

    def feed(self, some: bytes) -> list[int]:
        self.window += some
        self._extend()
        # tokens shared by the paths of all prefixes that a later token may lean on are final
        ends = range(max(0, len(self.window) - self.m.lookahead + 1), len(self.window) + 1)
        if ends[0] == 0:
            return []
        shared = self._path(ends[0])
        for e in ends[1:]:
            p = self._path(e)
            k = 0
            while k < min(len(p), len(shared)) and p[k] == shared[k]:
                k += 1
            shared = shared[:k]
        if shared:
            n = sum(self.m.size[t] for t in shared)
            # the walk back ends at the first byte kept, so remember what stands before it
            self.window, self.last = self.window[n:], self.last[n:]
            self.last[0] = shared[-1]
        return shared

    def end(self) -> list[int]:
        return self._path(len(self.window))


class Codec:
    """Encoder and decoder of whole texts."""

    def __init__(self, path: str):
        self.m = Merges(path)
        self.memo = Memo(MEMO)
        pattern = regex.compile(PATTERN)
        self.find, self.finditer = pattern.findall, pattern.finditer
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.m.special, key=len, reverse=True))) + ")") if self.m.special else None

    def _ids(self, word: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(self._stream(word)))

    def _stream(self, word: str) -> Iterator[list[int]]:
        """The ids of one word as the transducer makes them final."""
        raw, stream = word.encode("utf-8"), Transducer(self.m)
        for lo in range(0, len(raw), FEED):
            yield stream.feed(raw[lo : lo + FEED])
        yield stream.end()

    def parts(self, text: str) -> Iterator[tuple[list[str], list[int]]]:
        """The ids of a text, as text and as numbers, some thousands at a time however long the text or a word."""
        if len(text) < WHOLE:
            found = self.pieces(text)
            yield [name for name, _ in found], list(chain.from_iterable([ids for _, ids in found]))
            return
        names, ids = [], []
        for segment in self._segments(text):
            if segment in self.m.special:
                words = iter([segment])
            else:
                words = (m.group() for m in self.finditer(segment))
            for w in words:
                if len(w) > WHOLE:
                    more = self._stream(w)
                else:
                    more = [self.pieces_of([w])[0][1]]
                for some in more:
                    ids += some
                    if len(ids) >= 8192:
                        yield [",".join(map(str, ids))], ids
                        ids = []
        if ids:
            yield [",".join(map(str, ids))], ids

    def _segments(self, text: str) -> Iterator[str]:
        """Special tokens, and what stands between them."""
        if not self.specials or not any(s in text for s in self.m.special):
            yield text
            return
        at = 0
        for m in self.specials.finditer(text):
            yield text[at : m.start()]
            yield m.group()
            at = m.end()
        yield text[at:]

    def words(self, text: str) -> list[str]:
        if self.specials and any(s in text for s in self.m.special):
            return [w for part in self.specials.split(text) for w in ([part] if part in self.m.special else self.find(part))]
        return self.find(text)

    def pieces(self, text: str) -> list[tuple[str, tuple[int, ...]]]:
        """For each word, its ids as text and as numbers."""
        return self.pieces_of(self.words(text))

    def pieces_of(self, words: list[str]) -> list[tuple[str, tuple[int, ...]]]:
        found = list(map(self.memo.young.get, words))
        if None in found:
            memo, special = self.memo, self.m.special
            for i, v in enumerate(found):
                if v is None:
                    w = words[i]
                    if (v := memo.get(w)) is None:
                        ids = (special[w],) if w in special else self._ids(w)
                        v = (",".join(map(str, ids)), ids)
                        if len(w) <= 64:
                            memo.put(w, v)
                    found[i] = v
        return found

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable([ids for _, ids in self.pieces(text)]))

    def decode(self, ids: Iterable[int], step: int = 8192) -> Iterator[str]:
        """Text of ``ids``, piece by piece: what each step makes certain, then the rest."""
        machine, ids = Decoder(self.m), iter(ids)
        while some := list(islice(ids, step)):
            yield machine.feed(some)
        yield machine.end()


class Decoder:
    """Ids to text, an unfinished character held back between two feeds."""

    def __init__(self, merges: Merges):
        self.bytes, self.machine = merges.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join([self.bytes[i] for i in ids]))

    def end(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every whole text (null: empty).

    No shuffle.  An empty text has no tokens and the digest of nothing; an empty table no rows.  Null
    and repeated ids are rows like any other.  Of a long text, or a long word, some thousands of ids
    are held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        columns, flush = rows(SCHEMA)
        for b in batches:
            for lo, hi in parts(b.column(1)):
                for doc_id, text in zip(b.column(0)[lo:hi].to_pylist(), b.column(1)[lo:hi].to_pylist(), strict=True):
                    back, own, n, machine = hashlib.sha256(), hashlib.sha256(), 0, Decoder(c.m)
                    for names, ids in c.parts(text or ""):
                        if names:
                            own.update((b"," if n else b"") + ",".join(names).encode())
                        n += len(ids)
                        back.update(machine.feed(ids).encode("utf-8"))
                    back.update(machine.end().encode("utf-8"))
                    for column, v in zip(columns, (doc_id, n, own.hexdigest(), back.hexdigest()), strict=True):
                        column.append(v)
                yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
