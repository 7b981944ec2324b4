from fractions import Fraction

import corpus_pipeline
from gridtrack.llm import quality, simhash, suffix, toxicity
from gridtrack.llm.common import read
from gridtrack.llm.queries import learned_labels
from tests.llm.helpers import odd_docs, write_documents
from tests.llm.test_jaccard import brute as brute_groups
from tests.llm.test_suffix import brute


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], sf).write.parquet(str(tmp_path / str(i)))
        tables.append(spark.read.parquet(str(tmp_path / str(i))))
    start, good, clean, one, cut, packed = tables
    assert all(t.columns == corpus_pipeline.COLUMNS for t in tables[:-1])
    ids = [[r.doc_id for r in t.select("doc_id").collect()] for t in tables[:-1]]
    assert all(len(set(x)) == len(x) for x in ids)
    assert set(ids[1]) == {r.id for r in quality.judge(start).where("kept").collect()}
    model = toxicity.fit(good, learned_labels(spark, sf))
    assert set(ids[2]) == {r.id for r in toxicity.apply(good, model).where("score < 0.3").collect()}
    # five words, a similarity of 0.8: one of each group
    assert sorted(ids[3]) == sorted(g[0] for g in brute_groups([(r.doc_id, r.text) for r in clean.collect()]))
    texts = {r.doc_id: r.text or "" for r in one.collect()}
    assert set(ids[4]) == set(texts)
    gone = {k[0]: k[2] for k in brute(list(texts.items()), suffix.WIDTH)}
    for r in cut.collect():
        assert r.n_chars == len(r.text)
        # what repeats in 400 bytes goes, and at least that where runs of words go too
        assert len(texts[r.doc_id].encode()) - len(r.text.encode()) >= gone[r.doc_id]
    total = {}
    for r in packed.collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert r.doc_tokens >= r.start + r.length
    assert set(total) == set(ids[4])


def test_keep_one_with_repeated_ids(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "p q r s t u v", "x"), (2, "a b c d e f g", "y"), (None, "k l m n o p", "z"), (None, "k l m n o p", "z"), (3, None, "n"), (4, " ", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted(((r.doc_id or 0, r.text or "") for r in simhash.keep_one(df).collect()))
    assert kept == [(0, "k l m n o p"), (1, "a b c d e f g"), (1, "p q r s t u v"), (3, "")]


def test_keep_one_with_clashing_columns(spark):
    rows = [(1, "a b c d e f g", "mine", 7, 8, 9), (2, "a b c d e f g", "yours", 1, 2, 3), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string, _id long, _TH long, _n int")
    for least in (None, Fraction(4, 5)):
        kept = simhash.keep_one(df, least=least)
        assert kept.columns == df.columns
        assert sorted(kept.collect(), key=lambda r: r.doc_id) == [df.collect()[0], df.collect()[2]]


def test_run_on_odd_and_empty_tables(spark, sf, tmp_path):
    """Null ids, texts and languages, repeated rows and extra columns; and no rows at all."""
    odd = odd_docs(spark)
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        where = write_documents(spark, docs, tmp_path / name)
        read(spark, sf, "labels").write.parquet(f"{where}/labels.parquet")
        rows = corpus_pipeline.run(spark, where).collect()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
