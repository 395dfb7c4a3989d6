"""Language of each word by a linear-chain conditional random field, and of each text from its words.

A word is a run of letters, in lower case. Its features are hashed: all letter trigrams with marks for the word's
ends (which cover affixes of two), its first and last three letters, and the word itself (the lexicon). Emissions
are sums of their weights, transitions between the languages of neighbouring words are learned with them, and
forward-backward over the whole text gives each word's distribution, so the words of a code-switched text get labels of their own.
A text's score for a language is the mean over its words.

All work on letters is done for a batch of whole texts at once in numpy arrays.

The fit reads a bounded sample: at most ``per_language`` texts (``PER_LANGUAGE`` by default) of each language, or of the
``languages`` of most different texts (ties by code point) if a caller passes that number, chosen by a hash of text and language, each text once, whole, until the sample has
``MAX_CHARS`` characters. Where no number is passed, more than ``LANGUAGES`` languages are an error, as the driver holds weights of each: none is left out
unasked. The table is read twice for it, once to count the different texts of each language by their hashes, so copies change
neither how many nor which texts are chosen. Only text and language are learned from; prediction reads the text alone. A text has one
label, so by themselves the chosen texts would teach that languages never change: the chains learned from are the texts, and besides them
chains of ``SWITCH`` words of one text after as many of the next, dealt round the sample, which teach the changes.

Cases: null texts and texts without a letter are ``und`` with score 0. Null languages aren't learned from. With one
language learned every text of letters is of that language; with none, ``und``. Ties go to the first by code point.
Repeated rows are treated each by itself. Other columns pass through; the result columns replace those of their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chain
from .store import bounded_batches, table

WIDTH = 1 << 16
PER_LANGUAGE = 300
LANGUAGES = 400
MAX_CHARS = 200_000_000
SWITCH = 12
UNKNOWN = "und"

_letter: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letter


@dataclass
class Words:
    """The words of several texts: hashed trigrams (``tri``, sliced by ``start``), three more features each, the text of each, and its hash."""

    tri: np.ndarray
    start: np.ndarray
    more: np.ndarray
    text: np.ndarray
    whole: np.ndarray


def _slot(x: np.ndarray) -> np.ndarray:
    return (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)


def words_of(texts: list[str | None]) -> Words:
    lower = [(t or "").lower() for t in texts]
    code = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    end = np.cumsum([len(t) + 1 for t in lower])
    on = letters()[code]
    at = np.nonzero(on)[0]
    if not len(at):
        return Words(at, at, np.zeros((0, 3), dtype=np.int64), at, at)
    first = np.ones(len(at), dtype=bool)
    first[1:] = np.diff(at) > 1
    last = np.append(first[1:], True)
    c = code[at].astype(np.uint64)
    zero = np.uint64(0)
    left = np.where(first, zero, np.concatenate([c[:1], c[:-1]]))
    right = np.where(last, zero, np.append(c[1:], zero))
    tri = _slot(left << np.uint64(42) | c << np.uint64(21) | right)
    start, stop = np.nonzero(first)[0], np.nonzero(last)[0]
    n = len(c)
    pad = np.append(c, [zero] * 2)
    pick = lambda p, ok: np.where(ok, pad[np.clip(p, 0, n + 1)], zero)
    size = stop - start + 1
    head = _slot(np.uint64(1) << np.uint64(63) | pick(start, size > 0) << np.uint64(42) | pick(start + 1, size > 1) << np.uint64(21) | pick(start + 2, size > 2))
    tail = _slot(np.uint64(3) << np.uint64(62) ^ (pick(stop, size > 0) << np.uint64(42) | pick(stop - 1, size > 1) << np.uint64(21) | pick(stop - 2, size > 2)))
    power = (np.arange(n) - np.repeat(start, size)).astype(np.uint64)
    whole = np.add.reduceat((c + np.uint64(7)) * (power * np.uint64(0x632BE59BD9B4E019) + np.uint64(0x8CB92BA72F3D8DD7)), start)
    return Words(tri, start, np.stack([head, tail, _slot(whole)], 1), np.searchsorted(end, at[start], "right"), whole)


def forms(w: Words) -> tuple[Words, np.ndarray]:
    """The different words, and for each word the number of its form: features are worked out once for each form."""
    key = w.whole
    _, one, number = np.unique(key, return_index=True, return_inverse=True)
    size = np.diff(np.append(w.start, len(w.tri)))
    start = np.concatenate([[0], np.cumsum(size[one])[:-1]]).astype(np.int64)
    take = np.repeat(w.start[one] - start, size[one]) + np.arange(int(size[one].sum()))
    return Words(w.tri[take], start, w.more[one], np.zeros(len(one), dtype=np.int64), key[one]), number


def emissions(w: Words, weights: np.ndarray) -> np.ndarray:
    """(words, languages)."""
    if not len(w.start):
        return np.zeros((0, weights.shape[1]))
    few, number = forms(w)
    out = np.empty((len(few.start), weights.shape[1]))
    for k in range(weights.shape[1]):  # one column at a time keeps the gathers in cache
        column = np.ascontiguousarray(weights[:, k])
        out[:, k] = np.add.reduceat(column[few.tri], few.start) + column[few.more].sum(1)
    return out[number]


def word_marginals(w: Words, weights: np.ndarray, trans: np.ndarray) -> np.ndarray:
    return chain.whole_marginals(emissions(w, weights), w.text, trans)[0]


def _switched(text: np.ndarray, langs: np.ndarray, switch: int = SWITCH) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and sequence numbers of chains that change language: ``switch`` words of each text, one after the other, in four chains."""
    begin = np.nonzero(np.append(True, text[1:] != text[:-1]))[0]
    size = np.minimum(np.diff(np.append(begin, len(text))), switch)
    turn = {}
    order = []
    for i, lang in enumerate(langs[text[begin]].tolist()):  # one text of each language in turn
        turn[lang] = turn.get(lang, -1) + 1
        order.append((turn[lang], lang, i))
    order = np.array([i for *_, i in sorted(order)])
    words = np.concatenate([np.arange(begin[i], begin[i] + size[i]) for i in order])
    return words, np.repeat(np.arange(len(order)) * 4 // max(1, len(order)), size[order])


def fit_texts(texts: list[str], langs: np.ndarray, count: int, rounds: int = 25, ridge: float = 0.5, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (WIDTH, languages) and transitions, by Adagrad on the conditional likelihood of the words' labels. Only features that the
    sample has are worked on."""
    w = words_of(texts)
    if not len(w.start):
        return np.zeros((WIDTH, count), dtype=np.float32), np.zeros((count, count))
    few, number = forms(w)
    again, sequence = _switched(w.text, langs)
    words, sequence = np.concatenate([np.arange(len(w.start)), again]), np.concatenate([w.text, sequence + len(texts)])
    gold, number = langs[w.text][words], number[words]
    same = np.diff(sequence) == 0
    want = np.zeros((count, count))
    np.add.at(want, (gold[:-1][same], gold[1:][same]), 1)
    used, slot = np.unique(np.concatenate([few.tri, few.more.ravel()]), return_inverse=True)
    slot = slot[: len(few.tri)], slot[len(few.tri) :].reshape(few.more.shape)
    owner = np.repeat(np.arange(len(few.start)), np.diff(np.append(few.start, len(few.tri))))
    gold_sum = np.stack([np.bincount(number[gold == k], minlength=len(few.start)) for k in range(count)], 1)
    x, trans = np.zeros((len(used), count)), np.zeros((count, count))
    seen_x, seen_t = np.full_like(x, 1e-6), np.full_like(trans, 1e-6)
    for _ in range(rounds):
        score = np.stack([np.add.reduceat(x[slot[0], k], few.start) + x[slot[1], k].sum(1) for k in range(count)], 1)
        post, pairs = chain.whole_marginals(score[number], sequence, trans)
        rest = gold_sum - np.stack([np.bincount(number, weights=post[:, k], minlength=len(few.start)) for k in range(count)], 1)
        g = np.stack([np.bincount(slot[0], weights=rest[owner, k], minlength=len(used)) + sum(np.bincount(slot[1][:, j], weights=rest[:, k], minlength=len(used)) for j in range(3)) for k in range(count)], 1) - ridge * x
        seen_x += g * g
        x += rate * g / np.sqrt(seen_x)
        g = want - pairs - ridge * trans
        seen_t += g * g
        trans += rate * g / np.sqrt(seen_t)
    weights = np.zeros((WIDTH, count), dtype=np.float32)
    weights[used] = x
    return weights, trans


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray
    trans: np.ndarray


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, languages: int | None = None) -> Model:
    """Learn from ``docs``. Each language gives as many texts as ``per_language`` allows, chosen by a hash of text and language."""
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null and t <> ''")
    rows = rows.withColumn("h", F.xxhash64("t", "l"))
    counts = rows.select("l", "h").distinct().groupBy("l").agg(F.count("*").alias("n"))  # of texts, not of their copies
    if languages is not None:
        counts = counts.orderBy(F.col("n").desc(), "l").limit(languages)
    elif (found := counts.count()) > LANGUAGES:
        raise ValueError(f"{found} languages to learn, but the driver is taken to hold the weights of {LANGUAGES}: pass the number to learn")
    share = F.least(F.lit(1.0), F.lit(3.0 * per_language) / F.col("n"))
    some = rows.join(F.broadcast(counts), "l").withColumn("h", F.pmod("h", F.lit(1 << 30)))  # a row for each language
    some = some.where(F.col("h") < share * (1 << 30)).select("l", "h", "t").distinct().withColumn("chars", F.length("t"))
    rank = F.row_number().over(W.partitionBy("l").orderBy("h", "t"))
    chosen = some.withColumn("rank", rank).where(F.col("rank") <= per_language)
    upto = F.sum("chars").over(W.orderBy("rank", "l"))  # over ranks, languages and lengths; texts are read after the cut
    within = chosen.select("l", "rank", "chars").withColumn("upto", upto).where((F.col("upto") <= MAX_CHARS) | (F.col("rank") == 1)).select("l", "rank")
    got = sorted((r["l"], r["t"]) for r in chosen.join(within, ["l", "rank"]).select("l", "t").collect())
    if not got:
        return Model((), np.zeros((WIDTH, 0), dtype=np.float32), np.zeros((0, 0)))
    names = tuple(sorted({r[0] for r in got}))
    weights, trans = fit_texts([r[1] for r in got], np.array([names.index(r[0]) for r in got]), len(names))
    return Model(names, weights, trans)


RUN = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.LongType())]))


def identify(docs: DataFrame, model: Model, text: str = "text", runs: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score; with ``runs`` also the runs of words of one language, in order."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField("runs", RUN)] if runs else [])]
    rest = [f for f in docs.schema.fields if f.name.lower() not in {a.name for a in added}]
    place, names = [f.name for f in rest].index(text), [*(f.name for f in rest), *(a.name for a in added)]
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.trans))

    def run(batches):
        languages, weights, trans = held.value
        for batch in bounded_batches(batches, rows=2048, chars=1_500_000, column=place):
            w = words_of(batch.column(place).to_pylist())
            n, k = batch.num_rows, len(languages)
            label, score = np.full(n, -1), np.zeros(n)
            post = word_marginals(w, weights, trans) if k else np.zeros((0, 0))
            if k and len(post):
                size = np.bincount(w.text, minlength=n)
                mean = np.stack([np.bincount(w.text, weights=post[:, j], minlength=n) for j in range(k)], 1) / np.maximum(size, 1)[:, None]
                label = np.where(size > 0, mean.argmax(1), -1)
                score = np.where(size > 0, mean.max(1).clip(0, 1), 0.0)
            cells = [pa.array([languages[j] if j >= 0 else UNKNOWN for j in label], type=pa.string()), pa.array(score)]
            if runs:
                rows: list[list[dict]] = [[] for _ in range(n)]
                best = post.argmax(1) if len(post) else np.zeros(0, dtype=int)
                for d, j in zip(w.text[: len(best)].tolist(), best.tolist()):
                    if rows[d] and rows[d][-1]["lang"] == languages[j]:
                        rows[d][-1]["words"] += 1
                    else:
                        rows[d].append({"lang": languages[j], "words": 1})
                cells.append(pa.array(rows, type=pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells], names=names)

    return docs.select(*(F.col(f"`{f.name}`") for f in rest)).mapInArrow(run, T.StructType([*rest, *added]))


def op9_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = fit(docs.where(~held_out))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES, ORACLE = {"op9_language_crf": op9_language_crf}, {}
