"""Byte-level BPE encoding and decoding in padded matrices.

A pattern cuts texts into pieces; each piece is encoded by itself. A piece that is a token is that token. All others stand as rows of
token numbers in matrices, rows of like length together, the rest of a row padded. Beside each matrix stands one of the ranks of neighbouring
pairs, found in a hash table of all pairs whose bytes make a token. Each round merges the leftmost pair of least rank of every row, closes the
gap, and looks up the one or two pairs that this made; rows without pairs leave the matrix. In rows longer than ``WIDE`` the further occurrences
of that pair merge in the same round, where the merged token is in no pair of lower rank: then they would be the next ones in any case.

Different pieces of a task are encoded once, until the table of pieces holds over ``HELD`` tokens and starts anew. A task holds a slice of
texts, the table and one matrix of ``CELLS`` cells. Decoding gathers the tokens' bytes of a slice of rows at once.

The vocabulary is a rank file, a base64 token and its rank in each line, at a path that is a parameter: the driver reads it, and tasks get its
content by broadcast. It must hold all single bytes, and its size is that of a vocabulary, whatever the documents.

Cases: a null or empty text has no tokens. A null list of ids decodes to null, as does one with a number that isn't in the vocabulary or is
null. Special tokens' names are ordinary text. Repeated ids and rows each count. Columns other than id and text are not read, whatever their
names. An empty table gives an empty result. Ties of rank within a row go to the left.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bounded_batches, table

CELLS, WIDE, HELD = 1 << 20, 256, 2_000_000
NONE = np.iinfo(np.int32).max


class PairTable:
    """An open hash table from pairs of tokens to the token of their joined bytes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, NONE, dtype=np.int32)
        key, value = self.key(left, right), merged.astype(np.int32)
        slot = self.slot(key)
        while len(key):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[free]  # of several for one slot one stays
            self.values[slot[free]] = value[free]
            out = self.keys[slot] != key
            self.values[slot[~out]] = value[~out]
            key, value, slot = key[out], value[out], self.next(slot[out])

    @staticmethod
    def key(left, right):
        return left.astype(np.int64) << 32 | right

    def slot(self, key):
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def next(self, slot):
        return slot + 1 & (1 << self.bits) - 1

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged tokens, or ``NONE``; padding is -1 and is in no pair."""
        out = np.full(left.shape, NONE, dtype=np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = self.key(left.ravel()[todo], right.ravel()[todo])
        slot, flat = self.slot(key), out.ravel()
        while len(todo):
            held = self.keys[slot]
            same = held == key
            flat[todo[same]] = self.values[slot[same]]
            on = ~same & (held >= 0)
            todo, key, slot = todo[on], key[on], self.next(slot[on])
        return flat.reshape(left.shape)


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for the bytes {missing[:8]}")
        self.ranks, size = ranks, max(ranks.values()) + 1
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(a, b, t) for token, t in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        left, right, merged = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, merged)
        self.settled = np.ones(size, dtype=bool)  # in no pair of lower rank
        self.settled[left[merged < left]] = False
        self.settled[right[merged < right]] = False
        lengths = np.full(size, -1, dtype=np.int64)
        for token, t in ranks.items():
            lengths[t] = len(token)
        self.lengths, self.pool = lengths, np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), dtype=np.uint8)
        self.starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces in a row, and the number of each piece's."""
        counts, parts = np.zeros(len(pieces), dtype=np.int64), []
        whole = np.array([self.ranks.get(p, -1) for p in pieces], dtype=np.int64)
        counts[whole >= 0] = 1
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        rest = np.flatnonzero((whole < 0) & (size > 0))
        rest = rest[np.argsort(size[rest], kind="stable")]
        at = 0
        while at < len(rest):
            width = int(size[rest[at]] * 5 // 4 + 2)  # rows of like length
            end = int(np.searchsorted(size[rest], width, side="right"))
            end = min(end, at + max(1, CELLS // width))
            mine = rest[at:end]
            tokens, n = self.merge(self.matrix([pieces[i] for i in mine], size[mine]))
            counts[mine] = n
            parts.append((mine, tokens, n))
            at = end
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        out[(ends - counts)[whole >= 0]] = whole[whole >= 0]
        for mine, tokens, n in parts:
            out[spans((ends - counts)[mine], n)] = tokens
        return out, counts

    def matrix(self, pieces: list[bytes], size: np.ndarray) -> np.ndarray:
        m = np.full((len(pieces), int(size.max())), -1, dtype=np.int32)
        m[np.arange(m.shape[1]) < size[:, None]] = self.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        return m

    def merge(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all rows, and the number of each row's, once no pair is left."""
        m = np.hstack([m, np.full((len(m), 1), -1, dtype=np.int32)])
        rank = self.pairs.find(m[:, :-1], m[:, 1:])
        alive, done, counts = np.arange(len(m)), [], np.zeros(len(m), dtype=np.int64)
        while len(m):
            least = rank.min(1) if rank.shape[1] else np.full(len(m), NONE)
            over = least == NONE
            if over.any():
                left = m[over]
                counts[alive[over]] = (left >= 0).sum(1)
                done.append((alive[over], left[left >= 0]))
                m, rank, alive, least = m[~over], rank[~over], alive[~over], least[~over]
                continue
            m, rank = self.round(m, rank, least)
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=np.int32)
        for rows, tokens in done:
            out[spans(starts[rows], counts[rows])] = tokens
        return out, counts

    def round(self, m, rank, least):
        first, every = rank.argmin(1), np.arange(len(m))
        if m.shape[1] > WIDE and self.settled[least].any():
            hit = (rank == least[:, None]) & (self.settled[least][:, None] | (np.arange(rank.shape[1]) == first[:, None]))
            number = np.arange(rank.shape[1])
            run = np.maximum.accumulate(np.where(hit & ~np.pad(hit, ((0, 0), (1, 0)))[:, :-1], number, -1), axis=1)
            hit &= (number - run) % 2 == 0  # neighbours share a token: every second one merges
            gone = np.pad(hit, ((0, 0), (1, 0)))
            m[:, :-1][hit] = np.broadcast_to(least[:, None], hit.shape)[hit]
            keep = ~gone & (m >= 0)
            new = np.full((len(m), int(keep.sum(1).max()) + 1), -1, dtype=np.int32)
            r, _ = np.nonzero(keep)
            new[r, (np.cumsum(keep, axis=1) - 1)[keep]] = m[keep]
            return new, self.pairs.find(new[:, :-1], new[:, 1:])
        m[every, first] = least
        columns = np.arange(m.shape[1] - 1)
        m = np.take_along_axis(m, columns + (columns > first[:, None]), 1)  # each row is one shorter
        rank = np.take_along_axis(rank, columns[:-1] + (columns[:-1] > first[:, None]), 1)
        for at in (first - 1, first):
            fit = (at >= 0) & (at < rank.shape[1])
            rank[every[fit], at[fit]] = self.pairs.find(m[every[fit], at[fit]], m[every[fit], at[fit] + 1])
        return m, rank

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all tokens in a row, and the number of each token's."""
        n = self.lengths[ids]
        return self.pool[spans(self.starts[ids], n)], n


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each span of ``n``, one span after the other."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


@lru_cache(maxsize=2)
def vocabulary(content: bytes) -> Vocabulary:
    return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token})


def content_of(path: str) -> bytes:
    """The rank file, on the driver."""
    with open(path, "rb") as f:
        return f.read()


class Places(dict):
    """Numbers of pieces in the order in which they are first asked for; ``new`` has those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = n = len(self)
        return n


class Pieces:
    """The tokens of the pieces met so far."""

    def __init__(self, words: Vocabulary):
        self.words, self.place = words, Places()
        self.tokens, self.starts, self.counts = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces in a row, and the number of each piece's."""
        if len(self.tokens) > HELD:
            self.__init__(self.words)
        at = np.fromiter(map(self.place.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        tokens, counts = self.words.encode([p.encode() for p in self.place.new])
        self.place.new.clear()
        self.starts = np.concatenate([self.starts, len(self.tokens) + np.cumsum(counts) - counts])
        self.counts, self.tokens = np.concatenate([self.counts, counts]), np.concatenate([self.tokens, tokens])
        return self.tokens[spans(self.starts[at], self.counts[at])], self.counts[at]


def encode(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ids: the tokens of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(content_of(path))

    def run(batches):
        import regex

        cut, met = regex.compile(pattern).findall, Pieces(vocabulary(held.value))
        for part in bounded_batches(batches):
            pieces, number = [], []
            for t in part.column(1).to_pylist():
                mine = cut(t or "")
                pieces += mine
                number.append(len(mine))
            tokens, counts = met.of(pieces)
            ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(number)]).astype(np.int64)]
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id, "ids"])

    rows = docs.select(id, text)
    return rows.mapInArrow(run, f"`{id}` {rows.schema[id].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """id, ids, decoded: the bytes of each list of tokens."""
    held = encoded.sparkSession.sparkContext.broadcast(content_of(path))

    def run(batches):
        words = vocabulary(held.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column(1)
                numbers = np.asarray(pc.fill_null(lists.flatten(), -1)).astype(np.int64)
                size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
                edges = np.concatenate([[0], np.cumsum(size)])
                known = (numbers >= 0) & (numbers < len(words.lengths))
                known &= words.lengths[np.where(known, numbers, 0)] >= 0
                bad = np.concatenate([[0], np.cumsum(~known)])
                none = (bad[edges[1:]] > bad[edges[:-1]]) | np.asarray(pc.is_null(lists))
                numbers[np.repeat(none, size)] = words.bytes[0]
                data, n = words.decode(numbers)
                ends = np.concatenate([[0], np.cumsum(n)])[edges].astype(np.int64)
                whole = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
                whole = pc.if_else(pa.array(none), pa.scalar(None, pa.large_binary()), whole)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, whole.cast(pa.binary())], names=[id, ids, "decoded"])

    rows = encoded.select(id, ids)
    return rows.mapInArrow(run, f"`{id}` {rows.schema[id].dataType.simpleString()}, `{ids}` array<int>, decoded binary")


def op13_matrix_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = decode(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op13_matrix_byte_pairs": op13_matrix_byte_pairs}
ORACLE: dict[str, str] = {}
