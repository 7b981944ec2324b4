"""Quality rules by n-gram perplexity.

The language model counts characters, four in a row, one model for each value of the language
column.  A character is a class of 16 bits: its code point, or, beyond the basic plane, one of the
6,400 private ones by hash; the last class marks both ends of a text.  Spark counts the n-grams of
all texts that pass the base rule and have at most SYMBOLS_A_WORD symbols a word (junk that were
learned would look likely), and computes interpolated modified Kneser-Ney estimates from them with
joins, three discounts an order.  The model grows with the input; its arrays, sorted by n-gram, are
cut into pieces of at most PIECE entries, each a broadcast of its own, and a task holds no more
than a few of them at a time.

A text's perplexity is per character.  A language's band lies around the middle half of its texts'
log perplexities; short texts are drawn to the language's median by a prior of ``prior``
characters, so that chance alone doesn't reject them.  A text outside its band is rejected.  Texts
that quote another language are held to the model that fits each sentence best, of their own and
of the QUOTED most frequent ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridtrack.llm.common import forget, parts, rows, scratch, tidy

ORDER = 4
BITS = 16
BOUNDARY = (1 << BITS) - 1
SYMBOLS_A_WORD = 0.1
PIECE = 1 << 18  # entries of one broadcast array
HELD = 1 << 21  # entries a task keeps loaded
MERGE = 1 << 20  # n-grams a counting task gathers before it folds them
QUOTED = 8
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MIXED = 0.05  # above its language's mean by so much, a text's sentences are tried with other models
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?\n]+\s*|$)", re.S)


def classes(points: np.ndarray) -> np.ndarray:
    """The class of each code point."""
    p = points.astype(np.uint64)
    fold = np.uint64(0xE000) + (p * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(6400)
    return np.where((p >= BOUNDARY) | ((p >= 0xD800) & (p < 0xE000)), fold, p)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of all texts, packed, and where each text begins.  One a character and one for the end."""
    lengths = np.array([len(t) for t in texts], np.int64)
    pad = ORDER  # one end mark, the next text's context
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum(lengths + pad) - (lengths + pad)
    all_ = np.full(int((lengths + pad).sum()), BOUNDARY, np.uint64)
    at = np.arange(len(points)) + np.repeat(begin + ORDER - 1 - (np.cumsum(lengths) - lengths), lengths)
    all_[at] = classes(points)
    n = len(all_) - ORDER + 1
    code = np.zeros(n, np.uint64)
    for i in range(ORDER):
        code = (code << np.uint64(BITS)) | all_[i : i + n]
    own = np.ones(n, bool)  # not those that run over into the next text
    for k in range(1, ORDER):
        own[begin[1:] - k] = False
    return code[own].view(np.int64), np.cumsum(lengths + 1) - (lengths + 1)


def repeats(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = h[:n].copy()
    for k in range(1, width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    maybe = np.unique(np.concatenate([order[1:][same], order[:-1][same]])).tolist()
    first: dict[tuple, int] = {}
    hit = []
    for i in maybe:  # equal hashes are compared as words
        j = first.setdefault(tuple(words[i : i + width]), i)
        if j != i:
            hit += (i, j)
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(np.array(hit, np.int64))
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1) if starts.size and starts.max() + width <= len(words) else None
    return int((np.cumsum(cover)[: len(words)] > 0).sum())


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeats(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def _texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))


def _by_lang(langs: list[str]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, x in enumerate(langs):
        out.setdefault(x, []).append(i)
    return out


# ------------------------------------------------------------------ the model


def counted(texts: DataFrame) -> DataFrame:
    """``(lang, code, n)``: the n-grams of ``texts(text, lang)`` that are fit to be learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, chunks in held.items():
                code, n = np.unique(np.concatenate(chunks), return_counts=True)
                for lo in range(0, len(code), 100_000):
                    c = code[lo : lo + 100_000]
                    yield pa.record_batch([pa.array([lang] * len(c)), pa.array(c), pa.array(n[lo : lo + 100_000].astype(np.int64))], names=["lang", "code", "n"])
            held.clear()

        for b in batches:
            for lo, hi in parts(b.column(0), 1 << 20):
                texts, langs = b.column(0)[lo:hi].to_pylist(), b.column(1)[lo:hi].to_pylist()
                for lang, own in _by_lang(langs).items():
                    fit = []
                    for i in own:
                        n_words, _, n_symbols, _, again = measures(texts[i])
                        if not base_failed(n_words, again) and n_symbols <= SYMBOLS_A_WORD * n_words:
                            fit.append(texts[i])
                    if fit:
                        held.setdefault(lang, []).append(codes(fit)[0])
                        size += len(held[lang][-1])
                if size > 4 * MERGE:
                    yield from flush()
                    size = 0
        yield from flush()

    return texts.select("text", "lang").mapInArrow(tidy(run), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _discounts() -> dict[str, Column]:
    """What is taken off counts of 1, 2 and more, from the counts of counts n1 ... n4 of a language and order; small tables get milder ones."""
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    small = (F.col("n1") == 0) | (F.col("n2") == 0) | (F.col("n3") == 0)
    raw = [F.lit(1.0) - 2 * y * F.col("n2") / F.col("n1"), F.lit(2.0) - 3 * y * F.col("n3") / F.col("n2"), F.lit(3.0) - 4 * y * F.col("n4") / F.col("n3")]
    return {f"d{k + 1}": F.when(small, mild).otherwise(F.least(F.greatest(x, F.lit(0.05)), F.lit(k + 0.95))) for k, (x, mild) in enumerate(zip(raw, (0.5, 0.75, 0.9), strict=True))}


def estimates(counts: DataFrame) -> list[DataFrame]:
    """For each order from 1: ``(lang, code, n, p, g)``; p the probability of the last character, null
    for what is only a context; g the weight of the lower order after it, null where it is no context.

    Order 1 has a row of code null: p of a character never met.  Every order's counts and estimates are
    written before the next reads them, so no plan holds another's; sums are of whole numbers, so that
    no estimate depends on the order of rows.
    """
    own = [counts]
    for k in range(ORDER - 1, 0, -1):  # continuation counts
        low = F.col("code").bitwiseAND(F.lit((1 << k * BITS) - 1))
        own.append(scratch.table(own[-1].groupBy("lang", low.alias("code")).agg(F.count("*").alias("n")), f"grams{k}"))
    own.reverse()
    few = [t.groupBy("lang").agg(*(F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4))).select(F.lit(k).alias("k"), "*") for k, t in enumerate(own, 1)]
    off = scratch.table(reduce(DataFrame.unionByName, few).withColumns(_discounts()).select("k", "lang", "d1", "d2", "d3"), "discounts")  # a row a language and order

    def contexts(k: int) -> DataFrame:
        """``(lang, ctx, total, g)`` of an order's contexts."""
        met = [F.sum(is_.cast("long")).alias(f"c{i}") for i, is_ in ((1, F.col("n") == 1), (2, F.col("n") == 2), (3, F.col("n") > 2))]
        sums = own[k - 1].groupBy("lang", F.shiftrightunsigned("code", BITS).alias("ctx")).agg(F.sum("n").alias("total"), *met)
        taken = F.col("c1") * F.col("d1") + F.col("c2") * F.col("d2") + F.col("c3") * F.col("d3")
        return sums.join(off.where(F.col("k") == k), "lang").select("lang", "ctx", "total", (taken / F.col("total")).alias("g"))

    out: list[DataFrame] = []
    for k, table in enumerate(own, 1):
        n = F.col("n")
        taken = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        rest = contexts(k)
        met = table.join(off.where(F.col("k") == k), "lang").select("lang", "code", "n", taken.alias("off"), F.shiftrightunsigned("code", BITS).alias("ctx")).join(rest, ["lang", "ctx"])
        sure = (n - F.col("off")) / F.col("total")
        if k == 1:
            even = F.lit(1.0 / (1 << BITS))
            p = met.select("lang", "code", "n", (sure + F.col("g") * even).alias("p"))
            p = p.unionByName(rest.select("lang", F.lit(None).cast("long").alias("code"), F.lit(0).cast("long").alias("n"), (F.col("g") * even).alias("p")))
        else:
            low = out[-1].where("p IS NOT NULL AND code IS NOT NULL").select("lang", F.col("code").alias("suffix"), F.col("p").alias("low"))
            met = met.withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << (k - 1) * BITS) - 1)))
            p = met.join(low, ["lang", "suffix"]).select("lang", "code", "n", (sure + F.col("g") * F.col("low")).alias("p"))
        if k < ORDER:  # what is to be known of its strings as contexts
            after = contexts(k + 1).select("lang", F.col("ctx").alias("code"), "g")
            p = p.join(after, ["lang", "code"], "full").select("lang", "code", F.coalesce("n", F.lit(0)).alias("n"), "p", "g")
        out.append(scratch.table(p, f"order{k}"))
    for done in (off, *own[:-1]):
        scratch.drop(done)
    out[-1] = out[-1].withColumn("g", F.lit(None).cast("double"))
    return out


class Pieces:
    """One order's arrays: for each piece its languages, modulus and rest, and its broadcast."""

    def __init__(self, table: DataFrame, values: tuple[str, ...], piece: int):
        spark = table.sparkSession
        self.values, self.pieces = len(values), []
        sizes = [(r["lang"], r["count"]) for r in table.groupBy("lang").count().orderBy("lang").collect()]  # a row a language
        groups: list[tuple[list[str], int]] = []
        room = 0
        for lang, n in sizes:
            if n > piece:
                groups.append(([lang], _prime(-(-n // piece) + 1)))
                room = 0
            elif n <= room:
                groups[-1][0].append(lang)
                room -= n
            else:
                groups.append(([lang], 1))
                room = piece - n
        for langs, m in groups:
            for r in range(m):
                some = table.where(F.col("lang").isin(langs) & (F.pmod("code", F.lit(m)) == r)).select("lang", "code", *values).toArrow()  # about ``piece`` rows, sorted here: a job of one stage
                coded = some.column("lang").combine_chunks().dictionary_encode() if some.num_rows else None
                names = coded.dictionary.to_pylist() if coded is not None else []
                of = coded.indices.to_numpy() if coded is not None else np.empty(0, np.int32)
                arrays = [some.column(i).to_numpy() for i in range(1, some.num_columns)]
                own = {lang: np.flatnonzero(of == (names.index(lang) if lang in names else -1)) for lang in langs}
                own = {lang: at[np.argsort(arrays[0][at])] for lang, at in own.items()}
                self.pieces.append((tuple(langs), m, r, len(of), spark.sparkContext.broadcast({lang: [a[at] for a in arrays] for lang, at in own.items()})))
        scratch.release(spark)  # plans of the pieces, and the classes made for them, would stay in the driver

    def find(self, lang: str, want: np.ndarray, shelf: dict) -> tuple[np.ndarray, ...]:
        """Values of the n-grams ``want``, NaN where there are none; ``shelf`` keeps loaded pieces."""
        out = tuple(np.full(len(want), np.nan) for _ in range(self.values))
        for i, (langs, m, r, n, sent) in enumerate(self.pieces):
            if lang not in langs:
                continue
            some = np.flatnonzero(want % m == r) if m > 1 else None
            arrays = _loaded(shelf, (id(self), i), sent, n)[lang]
            key = want if some is None else want[some]
            if not len(key) or not len(arrays[0]):
                continue
            at = np.minimum(np.searchsorted(arrays[0], key), len(arrays[0]) - 1)
            hit = arrays[0][at] == key
            for column, a in zip(out, arrays[1:], strict=True):
                found = np.where(hit, a[at], np.nan)
                if some is None:
                    column[:] = found
                else:
                    column[some] = found
        return out


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _loaded(shelf: dict, key: tuple, sent, n: int) -> dict:
    """A piece's arrays; the longest unused are let go beyond HELD entries."""
    if key in shelf:
        shelf[key] = shelf.pop(key)
        return shelf[key][0]
    while shelf and n + sum(size for _, size in shelf.values()) > HELD:
        shelf.pop(next(iter(shelf)))
    value = sent.value
    forget(sent)
    shelf[key] = (value, n)
    return value


class Model:
    """All languages' models: arrays of each order, and the languages tried for quotations."""

    def __init__(self, orders: list[Pieces], unseen: dict[str, float], entropy: dict[str, float], quoted: list[str]):
        self.orders, self.unseen, self.entropy, self.quoted = orders, unseen, entropy, quoted

    def log(self, lang: str, code: np.ndarray, shelf: dict) -> np.ndarray:
        """Natural log probability of each n-gram's last character; unseen ones back off."""
        if lang not in self.unseen:
            return np.full(len(code), -BITS * np.log(2))
        code, back = np.unique(code, return_inverse=True)
        out = self.orders[-1].find(lang, code, shelf)[0]
        miss = np.flatnonzero(np.isnan(out))
        weight = np.ones(len(miss))
        for k in range(ORDER - 1, 0, -1):
            if not len(miss):
                break
            mask = np.uint64((1 << k * BITS) - 1)
            own = code[miss].view(np.uint64)
            context = (own >> np.uint64(BITS)) & mask
            suffix = own & mask
            g = self.orders[k - 1].find(lang, context.view(np.int64), shelf)[1]
            p = self.orders[k - 1].find(lang, suffix.view(np.int64), shelf)[0]
            weight = weight * np.where(np.isnan(g), 1, g)
            hit = ~np.isnan(p)
            out[miss[hit]] = weight[hit] * p[hit]
            miss, weight = miss[~hit], weight[~hit]
        out[miss] = weight * self.unseen[lang]
        return np.log(out)[back]


def train(docs: DataFrame, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model for each language, from the n-grams of all texts fit to be learned."""
    texts = _texts(docs, id_col, text_col, lang_col)
    counts = scratch.table(counted(texts), "ngrams")
    orders = estimates(counts)
    unseen = {r["lang"]: r["p"] for r in orders[0].where("code IS NULL").select("lang", "p").collect()}  # a row a language
    means = orders[-1].groupBy("lang").agg((-F.sum(F.col("n") * F.log("p")) / F.sum("n")).alias("h"), F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect()
    made = [Pieces(t.where("code IS NOT NULL"), ("p", "g") if k < ORDER else ("p",), piece) for k, t in enumerate(orders, 1)]
    for done in (counts, *orders):
        scratch.drop(done)
    return Model(made, unseen, {r["lang"]: r["h"] for r in means}, [r["lang"] for r in means[:QUOTED]])


def best_by_sentence(text: str, lang: str, model: Model, shelf: dict) -> float:
    """Log probability of a text whose every sentence goes to the model that likes it best."""
    code, begin = codes([x for x in SENTENCE.findall(text) if x] or [""])
    tried = {lang, *model.quoted}
    return float(np.max([np.add.reduceat(model.log(x, code, shelf), begin) for x in sorted(tried)], axis=0).sum())


def log_probabilities(texts: list[str], langs: list[str], model: Model, shelf: dict) -> tuple[np.ndarray, np.ndarray]:
    """For each text its log probability and the number of predicted characters."""
    log, events = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for lang, own in _by_lang(langs).items():
        code, begin = codes([texts[i] for i in own])
        log[own] = np.add.reduceat(model.log(lang, code, shelf), begin)
        events[own] = np.diff(np.r_[begin, len(code)])
        if lang in model.entropy and len(model.quoted) > 1:
            high = model.entropy[lang] + MIXED
            for i in (i for i in own if -log[i] > high * events[i]):
                log[i] = max(log[i], best_by_sentence(texts[i], lang, model, shelf))
    return log, events


# ------------------------------------------------------------------ rules

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "events")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All columns of ``docs`` as a struct ``doc``, and ``id, lang``, the base measures, ``events`` (predicted
    characters) and ``log_prob``."""
    schema = pa.schema([*((x, pa.int64()) for x in MEASURES), ("log_prob", pa.float64())])
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf: dict = {}
        for b in batches:
            for lo, hi in parts(b.column(2), 1 << 20):
                columns, _ = rows(schema)
                texts, langs = b.column(2)[lo:hi].to_pylist(), b.column(3)[lo:hi].to_pylist()
                log, events = log_probabilities(texts, langs, model, shelf)
                for text, n, p in zip(texts, events.tolist(), log.tolist(), strict=True):
                    for c, v in zip(columns, (*measures(text), n, p), strict=True):
                        c.append(v)
                yield pa.record_batch([b.column(0)[lo:hi], b.column(1)[lo:hi], b.column(3)[lo:hi], *(pa.array(c, f.type) for c, f in zip(columns, schema, strict=True))], names=["doc", "id", "lang", *schema.names])

    kind = whole.schema["doc"].dataType.simpleString()
    return whole.mapInArrow(tidy(run), f"doc {kind}, id long, lang string, {', '.join(f'{m} long' for m in MEASURES)}, log_prob double")


def bands(scored: DataFrame, width: float, prior: float, least_rows: int) -> DataFrame:
    """``(lang, median, lower, upper)`` of log perplexity; languages of few texts get the pooled band."""
    x = -F.col("log_prob") / F.col("events")
    medians = scored.groupBy("lang").agg(F.percentile_approx(x, 0.5, 10_000).alias("median"), F.count("*").alias("texts"))
    pulled = scored.join(medians, "lang").withColumn("x", (-F.col("log_prob") + prior * F.col("median")) / (F.col("events") + prior) - F.col("median"))
    quarters = F.percentile_approx("x", [0.25, 0.75], 10_000)
    pooled = pulled.agg(quarters.alias("pooled"))
    own = pulled.groupBy("lang", "median", "texts").agg(quarters.alias("own")).join(F.broadcast(pooled))  # one row
    q = F.when(F.col("texts") >= least_rows, F.col("own")).otherwise(F.col("pooled"))
    half = F.greatest(q[1] - q[0], F.lit(0.02)) * width
    return own.select("lang", "median", (q[0] - half).alias("lower"), (q[1] + half).alias("upper"))


def _judged(scored: DataFrame, width: float, prior: float, least_rows: int) -> DataFrame:
    x = (-F.col("log_prob") + prior * F.col("median")) / (F.col("events") + prior) - F.col("median")
    limits = scratch.table(bands(scored.select("lang", "log_prob", "events"), width, prior, least_rows), "bands")  # a row a language; small as read, so the scored rows stay where they lie
    out = scored.join(limits, "lang").withColumns(
        {"perplexity": F.exp(-F.col("log_prob") / F.col("events")), "deviation": x, "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))}
    )
    return out.withColumn("kept", ~F.col("base_failed") & F.col("deviation").between(F.col("lower"), F.col("upper"))).drop("median", "log_prob")


def judge(docs: DataFrame, width: float = 4.0, prior: float = 150.0, least_rows: int = 50, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, lang, the base measures, perplexity, band, base_failed, kept.

    ``width`` is the band's reach beyond the quartiles, in interquartile ranges.  Null texts count
    as empty: no words, so the base rule fails them.  A null language is the language ''.  A
    language without a text fit to be learned finds all characters equally likely.  Repeated rows
    are judged alike; whole texts are read, however long.  An empty table gives no rows.
    """
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(some, piece)
    scored = score(some, model).drop("doc")
    return _judged(scratch.table(scored, "quality"), width, prior, least_rows)


def keep(docs: DataFrame, width: float = 4.0, prior: float = 150.0, least_rows: int = 50, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, all columns as they were.

    Texts are scored once: the rows are written with their scores, and filtered where they lie by
    a join with a band for each language.
    """
    model = train(docs, piece, id_col, text_col, lang_col)
    scored = scratch.table(score(docs, model, id_col, text_col, lang_col), "quality")
    return _judged(scored, width, prior, least_rows).where("kept").select("doc.*")
