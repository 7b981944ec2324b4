import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridtrack.llm import packing
from gridtrack.llm.common import documents
from tests.llm.helpers import empty_docs, odd_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, n_open=packing.OPEN):
    rows = packing.pack(docs, PATH, end=2, most_open=n_open).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for r in docs.collect():
        want[(r.doc_id, *(ids := (*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2)))] += 1
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096
    by = defaultdict(list)
    for r in rows:
        by[(r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32)].append(r)
    for (doc_id, *ids), n in want.items():
        raw = np.array(ids, "<u4").tobytes()
        own = sorted((k for k in by if k[0] == doc_id and k[1] == len(ids) and zlib.crc32(raw[4 * k[2] : 4 * (k[2] + k[3])]) == k[4]), key=lambda k: k[2])
        assert sum(k[3] * len(by[k]) for k in own) >= n * len(ids)
    assert sum(r.length for r in rows) == sum(n * (len(k) - 1) for k, n in want.items())
    return len(windows), sum(r.length for r in rows)


def test_documents(spark, sf):
    n, total = check(documents(spark, sf))
    assert n <= -(-total // 4096) * 1.05 + 2


def test_odd(spark):
    check(odd_docs(spark), 1)
    check(odd_docs(spark), 3)
    assert packing.pack(empty_docs(spark), PATH, 2).count() == 0


def test_merge():
    fills = np.array([4096, 10, 4000, 96, 2048, 2048, 1])
    to, offset = packing.merge(fills, 4096)
    load = defaultdict(int)
    for w, n in zip(to, fills, strict=True):
        load[w] += n
    assert max(load.values()) <= 4096 and len(load) == 4
    assert {(w, o) for w, o in zip(to, offset, strict=True)} == set(zip(to.tolist(), offset.tolist(), strict=True)) and len(set(zip(to, offset, strict=True))) == 7


@pytest.mark.parametrize("text", ["á é", "x\x1cy z w", "ΑΣ ΟΔΟΣ", "a\n\nb", "  ", "'s 't I'll", "１２3"])
def test_chunks_equal_whole(text):
    tokenizer = Tokenizer.from_file(PATH)
    own = next(packing.Encoder(PATH, 2).ids([text]))
    assert np.frombuffer(own, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
