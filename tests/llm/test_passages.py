import random

import corpus_pipeline
from gridtrack.llm import suffix


def test_short_worded_passages_of_51_words_go(spark, sf):
    rng = random.Random(5)
    run = lambda n: " ".join(f"{rng.choice('abcdefghij')}{rng.randrange(100)}" for _ in range(n))
    long, short, other = run(51), run(50), run(70)
    texts = [f"{run(80)} {p} {run(90)}" for p in (long, short, other)] + [f"{run(60)} {p} {run(120)}" for p in (long.replace(" ", "\n"), short, other)]
    texts += [f"{long}", f"é {run(30)}", None, ""]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, df, sf).collect()}
    assert max(len(long), len(other)) < suffix.WIDTH
    for i, t in enumerate(texts):
        for p in (long, long.replace(" ", "\n"), other):
            t = (t or "").replace(p, "")
        assert (kept[i] or "") == t
