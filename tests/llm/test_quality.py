import math
import random
import re
from collections import Counter

import numpy as np

from gridtrack.llm import quality
from gridtrack.llm.common import documents
from tests.llm.helpers import empty_docs, odd_docs


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    inside = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_measures(spark, sf):
    texts = [r.text for r in documents(spark, sf).collect()] + ["a b c d e " * 9, "x\n\nx\n x\n\x0b\nx", "a b c d e f a b c d e", None, "  ", "　 \x85 é"]
    for t in texts:
        assert quality.measures(t or "") == brute(t)


class Plain:
    """Modified Kneser-Ney over characters by dictionaries, straight from its definition."""

    def __init__(self, texts):
        top = Counter()
        for t in texts:
            padded = ("^",) * 3 + tuple(t) + ("^",)
            top.update(padded[i : i + 4] for i in range(len(padded) - 3))
        self.n = {4: top}
        for k in (3, 2, 1):
            self.n[k] = Counter(g[1:] for g in self.n[k + 1])
        self.d, self.total, self.off = {}, {}, {}
        for k, table in self.n.items():
            n = [sum(v == i for v in table.values()) for i in (1, 2, 3, 4)]
            if min(n[:3]):
                y = n[0] / (n[0] + 2 * n[1])
                d = [min(max(x, 0.05), i + 0.95) for i, x in enumerate((1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]))]
            else:
                d = [0.5, 0.75, 0.9]
            self.d[k] = d
            for g, v in table.items():
                self.total[g[:-1]] = self.total.get(g[:-1], 0) + v
                self.off[g[:-1]] = self.off.get(g[:-1], 0) + d[min(v, 3) - 1]

    def p(self, g):
        if not g:
            return 1 / 65536
        ctx, n = g[:-1], self.n[len(g)].get(g, 0)
        if ctx not in self.total:
            return self.p(g[1:])
        return (n - (self.d[len(g)][min(n, 3) - 1] if n else 0) + self.off[ctx] * self.p(g[1:])) / self.total[ctx]

    def log(self, text):
        padded = ("^",) * 3 + tuple(text) + ("^",)
        return sum(math.log(self.p(padded[i : i + 4])) for i in range(len(padded) - 3))


LEARNED = ["the cat sat on the mat and the dog sat on the log too", "abracadabra and a quick brown fox with some other words here", "été 日本語 テスト 日本 한국어 текст и ещё слова one two three four", "the the cat and the other cat were here again with the dogs"]


def test_against_definition(spark):
    rows = [(i, t, "xx") for i, t in enumerate(LEARNED)] + [(9, "x %%% y *** z ||| w ### " * 4, "xx"), (10, "короткий", "yy"), (11, "another language with ten words or more in it, at least", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {"xx": Plain(LEARNED), "zz": Plain([rows[-1][1]])}
    for piece in (1 << 20, 50):  # all in one array, and in many
        model = quality.train(df, piece)
        assert set(model.unseen) == {"xx", "zz"}
        for lang, plain in want.items():
            for t in [*LEARNED, "entirely new, 中文 text % zq", ""]:
                code, _ = quality.codes([t])
                assert abs(model.log(lang, code, {}).sum() - plain.log(t)) < 1e-6 * max(1, len(t)), (lang, t, piece)
    assert max(len(p.pieces) for p in model.orders) > 2


def test_codes_keep_texts_apart():
    texts = ["ab", "", "xyz\n", "🙂"]
    code, begin = quality.codes(texts)
    alone = [quality.codes([t])[0] for t in texts]
    assert code.tolist() == np.concatenate(alone).tolist()
    assert begin.tolist() == [0, 3, 4, 9]


def test_judge(spark, sf):
    docs = documents(spark, sf)
    rows = {r.id: r for r in quality.judge(docs).collect()}
    for r in docs.collect():
        n, chars, symbols, dup, again = brute(r.text)
        own = rows[r.doc_id]
        assert (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words) == (n, chars, symbols, dup, again)
        assert own.base_failed == (n < 10 or 100 * again > 20 * n)
        assert not (own.base_failed and own.kept)
    assert sum(r.kept for r in rows.values()) > 0.6 * len(rows)
    assert sorted(r.doc_id for r in quality.keep(docs).collect()) == sorted(k for k, r in rows.items() if r.kept)


def test_junk_is_rejected_and_clean_texts_stay(spark):
    """On labelled texts of sf0.01, and on random code, symbol, table and shuffled texts made of clean ones."""
    where = "/root/testdata/sf0.01"
    docs = documents(spark, where).select("doc_id", "text", "lang")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    rng = random.Random(4)
    clean = [r for r in docs.collect() if labels.get(r.doc_id) == 1 and r.text and len(r.text.split()) >= 100][:25]
    made, names = [], {}

    def add(name, text, lang):
        names[-1 - len(made)] = name
        made.append((-1 - len(made), text, lang))

    for r in clean:
        words = r.text.split()
        add("symbols", " ".join(w + rng.choice("#*$%&") * 3 for w in words), r.lang)
        add("table", " | ".join(words), r.lang)
        if len(made) < 16:  # junk of one kind must be rare, or it is learned
            add("code", " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(9)) for _ in range(60)), r.lang)
        shuffled = list(r.text)
        rng.shuffle(shuffled)
        add("letters", "".join(shuffled), r.lang)
    rows = {r.id: r for r in quality.judge(docs.unionByName(spark.createDataFrame(made, docs.schema))).collect()}
    for name in set(names.values()):
        own = [rows[i] for i, k in names.items() if k == name]
        assert sum(not r.kept for r in own) >= 0.95 * len(own), name
    good = [rows[i] for i, q in labels.items() if q == 1 and not rows[i].base_failed]
    bad = [rows[i] for i, q in labels.items() if q == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)


def test_odd(spark):
    docs = odd_docs(spark)
    rows = quality.judge(docs).collect()
    assert len(rows) == docs.count()
    assert quality.keep(docs).count() == sum(r.kept for r in rows)
    assert quality.judge(empty_docs(spark)).count() == 0 == quality.keep(empty_docs(spark)).count()


def test_a_piece_of_the_model_is_one_job(spark):
    rows = [(lang, (i * 7919) % 1000 - 300, i / 1000.0) for lang in ("a", "b") for i in range(1000)] + [("c", 5, None)]
    table = quality.scratch.table(spark.createDataFrame(rows, "lang string, code long, p double").repartition(3), "order")
    spark.sparkContext.setJobGroup("pieces", "pieces")
    made = quality.Pieces(table, ("p",), 400)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("pieces"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 2 * len(made.pieces)  # the sizes take a few
    for _, _, _, _, sent in made.pieces:
        assert all((arrays[0][1:] > arrays[0][:-1]).all() for arrays in sent.value.values())
    for lang in ("a", "b", "c"):
        own = [(code, p) for x, code, p in rows if x == lang and p is not None]
        got = made.find(lang, np.array([code for code, _ in own], np.int64), {})[0]
        assert got.tolist() == [p for _, p in own]


def test_no_plan_of_the_model_holds_that_of_another_order(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("en" if c % 3 else "de", c, rng.randint(1, 6)) for c in {sum(rng.randrange(9) << 16 * i for i in range(4)) for _ in range(900)}]
    counts = spark.createDataFrame(rows, "lang string, code long, n long")
    plans, write = [], quality.scratch.table

    def table(df, *a, **b):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return write(df, *a, **b)

    monkeypatch.setattr(quality.scratch, "table", table)
    first = quality.estimates(write(counts.repartition(1), "ngrams"))
    assert max(plans) <= 12
    monkeypatch.undo()
    second = quality.estimates(write(counts.repartition(7), "ngrams"))
    for a, b in zip(first, second, strict=True):  # to the last bit
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
