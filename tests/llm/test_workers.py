"""What Python workers hold between tasks."""

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gridtrack.llm import common, packing, suffix, toxicity
from tests.llm.helpers import odd_docs, odd_texts


def test_a_worker_keeps_one_thing_and_other_tasks_let_it_go():
    one = common.kept("a", list)
    assert common.kept("a", list) is one
    assert common.kept("b", list) is not one and common.kept("a", list) is not one
    one = common.kept("a", list)
    assert list(common.tidy(iter, keep=True)([1])) == [1] and common.kept("a", list) is one
    assert list(common.tidy(iter)([1])) == [1] and common.kept("a", list) is not one


def test_passages_are_found_by_one_worker_a_task(spark):
    texts = suffix._texts(odd_docs(spark), "doc_id", "text")
    found = suffix.spots(texts, 15, 6, words=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow|PythonMapInArrow", plan)) == 1
    assert found.where("first % 5 = 0").count() > 0


def test_an_encoder_that_is_kept_forgets_by_generations_and_stays_right(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 8)
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, plain = packing.Encoder(path, 2), Tokenizer.from_file(path)
    texts = [t or "" for t in odd_texts()] + [f"word{i} w{i}, and same. {'é' * i}  \n and," for i in range(30)]
    want = [np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for t in texts]
    for size in (1, 7, len(texts)):
        assert [x for lo in range(0, len(texts), size) for x in encoder.ids(texts[lo : lo + size])] == want
    assert encoder.memo.old


def test_many_are_remembered_at_once():
    memo = packing.Memo(2)
    memo.put_all({"a": 1, "b": 2, "c": 3})
    memo.put_all({"d": 4})
    assert memo.young == {"d": 4} and memo.get("c") == 3 and "c" in memo.young


def test_numbered_words_are_forgotten_and_counts_stay_right(monkeypatch):
    monkeypatch.setattr(toxicity, "MEMO", 4)
    texts = ["Some words some", "", "other words 12", *(f"word{c} vile {c * 3} vile" for c in "abcdefgh")]
    keys = np.unique(np.array([h for w in ("some", "words", "vile", "aaa") for h in toxicity.terms_of(w)], np.int64))
    terms = toxicity.Terms(keys)
    for t in [*texts, *texts]:
        want = {}
        for w in toxicity.WORD.findall(t.lower()):
            for h in toxicity.terms_of(w):
                if h in keys:
                    want[int(np.searchsorted(keys, h))] = want.get(int(np.searchsorted(keys, h)), 0) + 1
        ids, n = terms.counts(t)
        assert dict(zip(ids.tolist(), n.tolist())) == want and ids.tolist() == sorted(want)
        assert len(terms.words) <= 4 + 8
