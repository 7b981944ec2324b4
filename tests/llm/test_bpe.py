import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridtrack.llm import bpe
from gridtrack.llm.common import documents
from tests.llm.helpers import empty_docs, odd_docs, odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def texts():
    rnd = random.Random(3)
    yield from (t or "" for t in odd_texts())
    yield from ("a" * 5000, "=" * 1000, "é" * 900, "日本語" * 300, "\x85\x1c a", "ab" * 2000 + "c")
    for _ in range(60):
        yield "".join(rnd.choice("abeinrst=-_") for _ in range(rnd.randrange(1, 1500)))
        yield "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x2FFF)])) for _ in range(200))


def test_encode_and_decode(tokenizer):
    c = bpe.codec(PATH)
    for t in texts():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert c.encode(t) == ids
        assert "".join(c.decode(ids, step=3)) == tokenizer.decode(ids, skip_special_tokens=False) == t


def test_decode_broken_bytes(tokenizer):
    rnd, c = random.Random(4), bpe.codec(PATH)
    for _ in range(200):
        ids = [rnd.randrange(50257) for _ in range(40)]
        assert "".join(c.decode(ids, step=1)) == tokenizer.decode(ids, skip_special_tokens=False)


def test_transducer_keeps_a_bounded_window():
    m = bpe.codec(PATH).m
    rnd = random.Random(6)
    word = "".join(rnd.choice("abeinrst") for _ in range(6000)).encode()
    stream, out, widest = bpe.Transducer(m), [], 0
    for i in range(0, len(word), 50):
        out += stream.feed(word[i : i + 50])
        widest = max(widest, len(stream.window))
    assert [m.bytes[i] for i in out + stream.end()] == m.merge(word)
    assert widest <= 3 * m.lookahead


def test_adjacent_is_what_the_merge_list_does():
    m, rnd = bpe.codec(PATH).m, random.Random(5)
    some = sorted(m.token)
    short = [t for t in some if len(t) <= 3]
    for pool in (some, short):
        for _ in range(3000):
            a, b = rnd.choice(pool), rnd.choice(pool)
            assert m.adjacent(m.token[a], m.token[b]) == (m.merge(a + b) == [a, b]), (a, b)


def test_digests(spark, sf, tokenizer):
    for docs in (documents(spark, sf), odd_docs(spark)):
        want = []
        for r in docs.collect():
            ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        key = lambda x: tuple(map(str, x))
        assert sorted(map(tuple, bpe.digests(docs, PATH).collect()), key=key) == sorted(want, key=key)
    assert bpe.digests(empty_docs(spark), PATH).count() == 0


def test_long_texts_go_through_in_parts(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "WHOLE", 4000)
    c, rnd = bpe.codec(PATH), random.Random(7)
    many = " ".join("".join(rnd.choice("abeinrst") for _ in range(rnd.randrange(1, 9))) for _ in range(4000))
    one = "".join(rnd.choice("abeinrst") for _ in range(9000))
    for t in (many, one, many[:9000] + "<|endoftext|>" + many[:9000]):
        ids, names, widest = [], [], 0
        for name, some in c.parts(t):
            ids += some
            names += name
            widest = max(widest, len(some))
        assert ids == tokenizer.encode(t, add_special_tokens=False).ids
        assert ",".join(names) == ",".join(map(str, ids))
        assert widest < 8192 + 300


def test_memory_does_not_grow_with_the_text(monkeypatch):
    """What is held besides the text and its encoding stays the same for a text four times as long."""
    import tracemalloc

    monkeypatch.setattr(bpe, "WHOLE", 1000)
    c, held = bpe.codec(PATH), {}
    for shape in ("ab", "ab cd "):
        for n in (10_000, 40_000):
            t = shape * (n // len(shape))
            list(c.parts(t[:5000]))  # fill the memo
            tracemalloc.start()
            for _ in c.parts(t):
                pass
            held[shape, n] = tracemalloc.get_traced_memory()[1] - 2 * n
            tracemalloc.stop()
        assert held[shape, 40_000] < held[shape, 10_000] + 400_000
