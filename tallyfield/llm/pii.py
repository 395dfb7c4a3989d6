"""Personal data: base patterns, and a linear-chain conditional random field over word shapes.

The field learns from the small labelled table of ``pii_examples`` and is decoded by Viterbi in numpy
batches. Its labels are none and kinds that the base patterns don't cover: ``tel`` (phone numbers
without a country code), ``ssn`` (national numbers), ``mail`` (addresses spelled in words), ``name``, ``address``, ``birth`` (dates of
birth), ``account`` (account, passport and routing numbers) and ``secret`` (passwords, keys and tokens). It adds
spans; where one overlaps a base span, the base span stays and the other goes. All of what makes a span is learned: the features are shapes
of words, counts of digits in runs of numbers, classes of the words around (a small lexicon of cues, given names, months, streets),
and the nearest cue before.

Decoding is exact. All plain words (without digits, of no class, and not near what makes them telling) share one emission, so ``reach`` can be worked out: a plain
word with so many plain words on both sides is "none" on the best path, whatever lies beyond. Sequences
are cut there; the pieces around the other words are padded and decoded together, so the work per plain
word is one test. If no such reach exists, whole texts are decoded.

Cases: a null text counts as empty and has no spans. Repeated rows are treated each by itself. Spans are
in code points, end exclusive. Other columns, whatever their names, pass through unless they are named
as the result column, which replaces them.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chain
from .pii_examples import GIVEN, learn_table
from .store import bounded_batches, set_aside, table

BASE = ("email", "ip", "card", "phone")
LABELS = ("", "tel", "ssn", "mail", "name", "address", "birth", "account", "secret")
KINDS = (*BASE, *LABELS[1:])
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]+")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str):
    """From each at-sign back to the start of its local part and on over its domain: linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass its test, by start, then kind as listed."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            if m[0].count(".") >= 3:  # of a chain of numbers, four at a time
                parts = [(x.start() + m.start(), x.end() + m.start(), x[0]) for x in _NUMBER.finditer(m[0])]
                for four in (parts[i : i + 4] for i in range(0, len(parts) - 3, 4)):
                    if all(len(x[2].lstrip("0")) <= 3 and int(x[2].lstrip("0") or 0) <= 255 for x in four):
                        out.append(("ip", four[0][0], four[3][1]))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- the field


_RUN = re.compile(r"([A-Z]+)|([^\W\d_A-Z]+)|([0-9]+)")
_EDGE = ".,;:!?\"'()[]{}<>#*&%$|"
PLAIN, CAPITAL, STATE, NUMBER = 0, 1, 2, 3
#: Classes of words by their lower-case form; fixed values.
CUES = {
    "at": "at", "dot": "dot", "=": "equal", ":=": "equal",
    "tel": "call phone phones telephone mobile fax text dial ring cell tel reach",
    "ssn": "ssn social security",
    "born": "born birth dob birthday",
    "account": "account acct iban routing passport",
    "secret": "password passwd pwd secret token api_key apikey key api",
    "name": "name named contact signed dear patient met ask asked",
    "street": "street st avenue ave road rd lane ln drive boulevard blvd court terrace square straße strasse",
    "month": "january february march april may june july august september october november december",
    "unit": "apt suite unit po box",
    "title": "mr mrs ms dr prof herr frau",
}
CUES["equal"], CUES["at"], CUES["dot"] = "= :=", "at", "dot"
NAMES = ("at", "dot", "equal", "tel", "ssn", "born", "account", "secret", "name", "street", "month", "unit", "title", "given")
CODE = {name: 4 + i for i, name in enumerate(NAMES)}
CLASS = {w: CODE[k] for k in NAMES[:-1] for w in CUES[k].split()}
ASKED = frozenset(CODE[k] for k in ("tel", "ssn", "born", "account", "secret", "name"))
#: Given names of the lexicon: two of three of those to learn from, so that the field learns to do without.
CLASS |= {w.lower(): CODE["given"] for i, w in enumerate(GIVEN[0]) if i % 3 and w.lower() not in CLASS}
NEAR = frozenset(CODE[k] for k in ("name", "street", "unit", "title", "given"))
AT, DOT, STREET, TITLE, GIVEN_NAME = (CODE[k] for k in ("at", "dot", "street", "title", "given"))
_CAPITAL = re.compile(r"[A-ZÀ-Þ][\w'’-]*")
_HEX = re.compile(r"[0-9a-f]{16,}")


def word_class(word: str) -> int:
    if not word.isalpha():
        if _DIGIT.search(word) or "@" in word:
            return NUMBER
        if word in ("=", ":="):
            return CODE["equal"]
        word = word.strip(_EDGE)
    known = CLASS.get(word.lower(), PLAIN)
    if (known in (GIVEN_NAME, TITLE) or (known == STREET and len(word) < 5)) and not word.istitle():
        return PLAIN
    return known or (STATE if len(word) == 2 and word.isupper() else CAPITAL if _CAPITAL.fullmatch(word) else PLAIN)


def plain(word: str) -> bool:
    return word_class(word) < NUMBER


def shape(word: str) -> str:
    """Letters as X or x, once for a run; digits as 9, up to five for a run."""
    return _RUN.sub(lambda m: "X" if m[1] else "x" if m[2] else "9" * min(5, len(m[3])), word)[:40]


def odd_words(classes: list[int]) -> dict[int, str]:
    """The words that have features of their own, each with its part in a spelled address (or nothing): those of a class, capitals within
    two words of one that names go with, two capital letters before a number, and the words around an "at" that a "dot" follows."""
    odd: dict[int, str] = {}
    n = len(classes)
    marked = [i for i, c in enumerate(classes) if c >= NUMBER]
    for i in marked:
        odd.setdefault(i, "")
        for j in range(max(0, i - 2), min(n, i + 3)) if classes[i] in NEAR else ():
            if classes[j] in (CAPITAL, STATE):
                odd.setdefault(j, "")
        if classes[i] == NUMBER and i and classes[i - 1] == STATE:
            odd.setdefault(i - 1, "")
        if classes[i] == AT:
            dots = [j for j in range(i + 2, min(n, i + 6)) if classes[j] == DOT]
            if dots:
                start = i - 3 if i > 2 and classes[i - 2] == DOT else i - 1
                for j in range(max(0, start), min(n, dots[-1] + 2)):
                    odd[j] = f"{'before' if j < i else 'at' if j == i else 'dot' if classes[j] == DOT else 'last' if j > dots[-1] else 'host'}{min(i - j, 3) if j < i else ''}"
    return odd


def features(words: list[str], classes: list[int], i: int, spelled: str) -> tuple[str, ...]:
    word, c, n = words[i], classes[i], len(words)
    core = word.strip(_EDGE)
    at = lambda j: classes[j] if 0 <= j < n else -1
    p2, p1, n1, n2 = at(i - 2), at(i - 1), at(i + 1), at(i + 2)
    out = ["bias", f"k={c}", f"p1={p1},{c}", f"n1={n1},{c}", f"p2={p2},{c}", f"n2={n2},{c}", f"b={p1},{c},{n1}", f"a={p2},{p1},{c}", f"e={word[-1] in '.,;:!?'},{c}"]
    if spelled:
        out += ["m=" + spelled, f"me={spelled},{word[-1] in '.,;:!?'},{n1 in (AT, DOT)}"]
    cue = next((classes[j] for j in range(i - 1, max(-1, i - 6), -1) if classes[j] in ASKED), -1)
    told = next((classes[j] for j in range(i + 1, min(n, i + 5)) if classes[j] in ASKED), -1)
    street = next((j - i for j in range(i, min(n, i + 4)) if classes[j] == STREET), -1)
    back = next((i - j for j in range(i, max(-1, i - 7), -1) if classes[j] == STREET), -1)
    out += [f"q={cue},{c}", f"t={street},{c}", f"u={back},{c},{p1}"]
    if c == NUMBER:
        s = shape(core)
        short = re.sub("9+", "9", s)
        digits = len(_DIGIT.findall(core))
        low, high = i, i
        bare = lambda j: 0 <= j < n and classes[j] == NUMBER and not any(x.isalpha() for x in words[j])
        if bare(i):
            while i - low < 6 and bare(low - 1) and words[low - 1][-1] not in ",;":
                low -= 1
            while high - i < 6 and bare(high + 1) and words[high][-1] not in ",;":
                high += 1
        run = ".".join(str(min(20, len(_DIGIT.findall(words[j])))) for j in range(low, high + 1))
        value = core.rpartition("=")[2].strip(_EDGE)
        kind = "hex" if _HEX.fullmatch(value) and digits < len(value) else "long" if len(value) >= 16 and digits < len(value) else ""
        lead = re.match(r"[A-Za-z_]*", core)[0].lower() if "=" in core else ""
        out += ["s=" + s, "c=" + short, f"d={digits}", f"R={run}", f"r={run},{low - i}", f"Q={cue},{run}", f"T={told},{run}", f"qs={cue},{s}", f"qc={cue},{short}", f"K={kind}", f"l={len(core) > 5},{any(x.isalpha() for x in core)}", f"cp={p1},{short}", f"cn={n1},{short}"]
        if CLASS.get(lead) == CODE["secret"]:
            out.append("g=secret")
    elif c >= NUMBER or core.isupper():
        out += [f"w={core.isupper()},{len(core) == 2},{c}"]
    return tuple(out)


def coded(words: list[str]) -> dict[int, tuple[str, ...]]:
    classes = [word_class(w) for w in words]
    return {i: features(words, classes, i, spelled) for i, spelled in odd_words(classes).items()}


NONE = ("bias", "plain")


def fit(rows, rounds: int = 150, ridge: float = 0.05):
    """(feature -> weights of the labels, transitions) from rows of (word, label)."""
    rows = [r for r in rows if r]
    names: dict[str, int] = {}
    slots, owner, gold, text = [], [], [], []
    for k, r in enumerate(rows):
        own = coded([w for w, _ in r])
        for i, (_, y) in enumerate(r):
            mine = [names.setdefault(f, len(names)) for f in own.get(i, NONE)]
            slots += mine
            owner += [len(gold)] * len(mine)
            gold.append(LABELS.index(y))
            text.append(k)
    slots, owner, gold, text = map(np.array, (slots, owner, gold, text))
    labels, width, n = len(LABELS), len(names), len(gold)
    one = np.eye(labels)[gold]
    gather = lambda rest: np.stack([np.bincount(slots, weights=rest[owner, j], minlength=width) for j in range(labels)], 1)
    same = text[1:] == text[:-1]
    want = np.zeros((labels, labels))
    np.add.at(want, (gold[:-1][same], gold[1:][same]), 1)

    def gradient(p):
        w, trans = p[: width * labels].reshape(width, labels), p[width * labels :].reshape(labels, labels)
        score = np.stack([np.bincount(owner, weights=w[slots, j], minlength=n) for j in range(labels)], 1)
        post, pairs = chain.whole_marginals(score, text, trans)
        return np.concatenate([(gather(one - post) - ridge * w).ravel(), (want - pairs - ridge * trans).ravel()])

    p = chain.ascend(gradient, width * labels + labels * labels, rounds, 0.2)
    w, trans = p[: width * labels].reshape(width, labels), p[width * labels :].reshape(labels, labels)
    return {f: w[i].tolist() for f, i in names.items()}, trans.tolist()


@lru_cache(maxsize=1)
def learned():
    return fit(learn_table())


def reach(e: np.ndarray, trans: np.ndarray, most: int = 40) -> int | None:
    """The least k for which a plain word (emission ``e``) with k plain words on both sides is none on the best path.

    A stretch of other labels over that word lies inside the run of plain words, or leaves it at one end after k
    words or more, or at both. In each case turning its plain words to none must gain; this is tried for each length,
    and past ``most`` the gain grows with each word if the best cycle of other labels is below none's own.
    """
    gain = trans[1:, 1:] + e[None, 1:] - (trans[0, 0] + e[0])
    inside, left, right, both = [], [], [], []
    stay = np.where(np.eye(len(e) - 1, dtype=bool), 0.0, -np.inf)
    for _ in range(2 * most + 1):  # stay: from the first to the last word of the stretch
        start, end = trans[:, 1:] + e[None, 1:] - trans[:, :1] - e[0], trans[1:, :] - trans[:1, :]
        at = (start[:, :, None] + stay[None]).max(1)
        inside.append((at[0] + end[:, 0]).max())
        left.append(max((at + end[None, :, 0]).max(), (e[1:] - e[0] + stay.max(0) + end[:, 0]).max()))
        right.append(max((at[0][:, None] + end).max(), at[0].max()))
        both.append(max((at[:, :, None] + end[None]).max(), at.max()))
        stay = (stay[:, :, None] + gain[None]).max(1)
    cycle = max(np.diag(p).max() / (i + 1) for i, p in enumerate(_powers(gain, len(gain))))
    if cycle >= 0 or max(inside) >= 0:
        return None
    return next((k for k in range(1, most) if max(left[k:]) < 0 and max(right[k:]) < 0 and max(both[2 * k :]) < 0), None)


def _powers(gain: np.ndarray, n: int):
    now = gain
    for _ in range(n):
        yield now
        now = (now[:, :, None] + gain[None]).max(1)


class Decoder:
    """Labels the words of texts. Emissions are kept by features; plain words share one."""

    def __init__(self, model, keep: int = 100_000):
        weights, trans = model
        self.weights, self.trans, self.keep = {k: np.array(v) for k, v in weights.items()}, np.array(trans), keep
        self.classes: dict[str, int] = {}
        self.clear()
        self.reach = reach(self.rows[0], self.trans)

    def clear(self) -> None:
        self.seen, self.rows = {}, []
        self.code(NONE)

    def code(self, key: tuple[str, ...]) -> int:
        got = self.seen.get(key)
        if got is None:
            got = self.seen[key] = len(self.rows)
            self.rows.append(sum((self.weights[f] for f in key if f in self.weights), np.zeros(len(LABELS))))
        return got

    def odd(self, words: list[str]) -> dict[int, int]:
        """The emission of each word that isn't plain."""
        known = self.classes
        classes = [known.get(w, -1) for w in words]
        if -1 in classes:
            if len(known) > 5 * self.keep:
                known.clear()
            for i, c in enumerate(classes):
                if c < 0:
                    classes[i] = known[words[i]] = word_class(words[i])
        if not classes or max(classes) < NUMBER:
            return {}
        return dict(sorted((i, self.code(features(words, classes, i, spelled))) for i, spelled in odd_words(classes).items()))

    def labels(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each text the (word number, label) of all words that aren't none."""
        if len(self.rows) > self.keep:
            self.clear()
        k = self.reach
        runs, out = [], [[] for _ in texts]
        for number, text in enumerate(texts):
            words = text.split()
            odd = self.odd(words)
            if k is None:
                pieces = [[0, len(words)]] if words else []
            else:
                pieces = []
                for i in odd:
                    if pieces and i - k <= pieces[-1][1]:
                        pieces[-1][1] = min(len(words), i + k + 1)
                    else:
                        pieces.append([max(0, i - k), min(len(words), i + k + 1)])
            runs += [(number, a, [odd.get(i, 0) for i in range(a, b)], len(words)) for a, b in pieces]
        rows, size = np.array(self.rows), len(LABELS)
        runs.sort(key=lambda r: len(r[2]))
        start = 0
        while start < len(runs):
            n = 1
            while start + n < len(runs) and n < 4000 and (n + 1) * len(runs[start + n][2]) <= 200_000:
                n += 1
            part = runs[start : start + n]
            start += n
            length = np.array([len(r[2]) for r in part])
            steps = int(length.max())
            at = np.zeros((steps, n), dtype=int)
            for j, r in enumerate(part):
                at[: len(r[2]), j] = r[2]
            first, last = np.zeros((n, size)), np.zeros((n, size))
            first[[r[1] > 0 for r in part]] = self.trans[0]
            last[[r[1] + len(r[2]) < r[3] for r in part]] = self.trans[:, 0]
            best = chain.viterbi(rows[at], self.trans, length, first, last)
            for t, j in zip(*np.nonzero((best > 0) & (np.arange(steps)[:, None] < length))):
                out[part[j][0]].append((part[j][1] + int(t), int(best[t, j])))
        return [sorted(x) for x in out]


def added_spans(text: str, labels: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Neighbouring words of one label make a span, without punctuation at its ends; none that meets a base span."""
    if not labels:
        return []
    want, where = dict(labels), {}
    for i, m in enumerate(_WORD.finditer(text)):
        if i in want:
            where[i] = m.span()
    spans, last = [], None
    for i, y in labels:
        if last is not None and last == (i - 1, y):
            spans[-1][2] = where[i][1]
        else:
            spans.append([LABELS[y], *where[i]])
        last = (i, y)
    out = []
    for kind, a, b in spans:
        while b > a and text[b - 1] in ".,;:!?\"'":
            b -= 1
        while a < b and text[a] in "\"'":
            a += 1
        if kind == "secret" and "=" in (lead := text[a:b].rstrip("=").rpartition("=")[0] + "=") and lead != "=":
            a += len(lead)
        if b > a and not any(a < y and x < b for _, x, y in base):
            out.append((kind, a, b))
    return out


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with a column of spans: kind, start, end, and whether a base pattern found it."""
    model = learned()
    rest = [f for f in docs.schema.fields if f.name.lower() != into.lower()]
    schema = T.StructType([*rest, T.StructField(into, SPANS)])
    keep, place = [f.name for f in rest], [f.name for f in rest].index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        decoder = Decoder(model)
        for batch in bounded_batches(batches, column=place):
            texts = [x or "" for x in batch.column(place).to_pylist()]
            spans = []
            for body, labels in zip(texts, decoder.labels(texts)):
                base = base_spans(body)
                every = [(*s, True) for s in base] + [(*s, False) for s in added_spans(body, labels, base)]
                spans.append([dict(zip(("kind", "start", "end", "base"), s)) for s in sorted(every, key=lambda s: (s[1], KINDS.index(s[0])))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, type=kind)], names=[*keep, into])

    return docs.select(*(F.col(f"`{k}`") for k in keep)).mapInArrow(run, schema)


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span, or run of overlapping spans, replaced by its first kind in angle brackets.
    Null texts stay null. ``n_chars``, where there is one, is counted anew."""
    rows, back = set_aside(docs, {"_pii"})
    found = find_pii(rows, text, "_pii")
    state = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        clear = s["start"] >= acc["at"]
        piece = F.when(clear, F.concat(F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")
        return F.struct(F.concat(acc["done"], piece).alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    walked = F.aggregate("_pii", state, step, lambda acc: F.concat(acc["done"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(text))))
    out = back(found.withColumn(text, F.when(F.size("_pii") > 0, walked).otherwise(F.col(text))))
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("pii")).alias("spans"))


QUERIES, ORACLE = {"op1_pii_crf": op1_pii_crf}, {}
