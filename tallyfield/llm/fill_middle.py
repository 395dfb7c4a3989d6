"""Fill-in-middle transformation, assembled by a secondary sort.

A text is cut into units, runs of letters A-Z and a-z or else single code points. Hashes of the seed and the document's id choose two cuts
and a form. Every text is emitted as pieces of at most ``CHUNK`` units, keyed by (row, place in the output); a marker stands before the
first piece of its part. ``repartitionAndSortWithinPartitions`` brings the pieces of a row together in the order of the output, and one
pass over each partition folds them into digests. For restoration the same pieces, parted at the markers that the pass finds in
the output, get the place that they have in the text and are sorted again; as the partitioning is the same, this second sort moves nothing
between machines. A task holds a piece at a time, besides the sorter's buffer, which spills; how long a text is doesn't matter there. Only
the task that cuts a text has it whole, as it is one cell of the table.

A row's key is the number of its partition, a hash of its id and text, and a count among equal ones of the partition. So copies
are rows of their own and don't gather in one partition, and a task that runs again emits the same keys, in whatever order it reads.

Cases: a null text counts as empty, and an empty text has no units and is plain. A null id is hashed as an empty one. Repeated ids get the same
hashes. A text with a marker in it is plain. Columns other than id and text are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import groupby

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .store import table

SEED = 1
#: Percent of the texts that are transformed, and percent of these that begin with the suffix.
RATE, SUFFIX_FIRST = 90, 20
MARKERS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
#: The parts of a text as they follow each other in the output of each form, and in the text itself.
FORMS = {"plain": (), "psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
TEXT = ("prefix", "middle", "suffix")
CHUNK = 4096
#: Bytes of a text that are looked at together, and places between the parts of a restored text.
BLOCK, PART = 1 << 20, 1 << 40
#: A task sorts about so many bytes of text, and more where the number of tasks would exceed the second figure.
TASK_BYTES, MOST_TASKS = 128 << 20, 20_000


def unit_starts(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """Offsets in ``low`` to ``high`` of UTF-8 bytes at which a unit begins."""
    seen = data[max(0, low - 1) : high]
    letter = ((seen | 32) - np.uint8(97)) < 26
    begins = (seen & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins[1:] if low else begins) + low


class Units:
    """The units of a text in UTF-8: their number, and the offsets of those asked for."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, dtype=np.uint8)
        self.blocks = [(i, min(i + BLOCK, len(data))) for i in range(0, len(data), BLOCK)]
        self.before = np.cumsum([0] + [len(unit_starts(self.data, *b)) for b in self.blocks])
        self.n = int(self.before[-1])

    def offsets(self, wanted: np.ndarray) -> np.ndarray:
        """Where the units of these sorted numbers begin; ``n`` is the end of the text."""
        out = np.full(len(wanted), len(self.data), dtype=np.int64)
        first = np.searchsorted(wanted, self.before)
        for k, block in enumerate(self.blocks):
            if first[k] < first[k + 1]:
                mine = slice(first[k], first[k + 1])
                out[mine] = unit_starts(self.data, *block)[wanted[mine] - self.before[k]]
        return out

    def points(self, low: int, high: int) -> int:
        return sum(int(np.count_nonzero((self.data[i : min(i + BLOCK, high)] & 0xC0) != 0x80)) for i in range(low, high, BLOCK))


def choice(id, data: bytes, n: int, seed: int = SEED) -> tuple[str, int, int]:
    """Form, and the numbers of units after which prefix and middle end."""
    digest = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    cuts = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not data or h[2] % 100 >= RATE or any(m in data for m in MARKERS.values()):
        return "plain", *cuts
    return ("spm" if h[3] % 100 < SUFFIX_FIRST else "psm"), *cuts


def cut(key: bytes, id, data: bytes, seed: int = SEED, chunk: int = CHUNK):
    """((key, place), value) of a text: its facts at place 0, then the pieces of the output."""
    units = Units(data)
    form, a, b = choice(id, data, units.n, seed)
    ends = {"prefix": (0, a), "middle": (a, b), "suffix": (b, units.n)}
    parts = [(MARKERS[p], *ends[p]) for p in FORMS[form]] or [(b"", 0, units.n)]
    steps = [np.append(np.arange(low, high, chunk), high) for _, low, high in parts]
    wanted = np.unique(np.concatenate(steps))
    offsets = units.offsets(wanted)
    where = dict(zip(wanted.tolist(), offsets.tolist()))
    chars = [None if form == "plain" else units.points(where[ends[p][0]], where[ends[p][1]]) for p in ("prefix", "middle")]
    yield (key, 0), (id, units.n, form, *chars)
    place = 0
    for (marker, _, _), step in zip(parts, steps):
        edges = [where[s] for s in step.tolist()]
        for low, high in zip(edges, edges[1:] or edges):  # an empty part has one edge, and its marker
            place += 1
            yield (key, place), marker + data[low:high]
            marker = b""


class Parted:
    """The pieces of an output as they come, without markers, each with the place that it has in the text."""

    def __init__(self, form: str):
        self.coming, self.part, self.held, self.seen = list(FORMS[form]), "prefix", b"", 0

    def place(self, data: bytes):
        if data:
            self.seen += 1
            yield TEXT.index(self.part) * PART + self.seen, data

    def take(self, data: bytes, last: bool = False):
        data = self.held + data
        while self.coming and (found := data.find(MARKERS[self.coming[0]])) >= 0:
            yield from self.place(data[:found])
            self.part = self.coming.pop(0)
            data = data[found + 3 :]
        keep = min(2, len(data)) if self.coming and not last else 0  # a marker may go on in the next piece
        self.held = data[len(data) - keep :]
        yield from self.place(data[: len(data) - keep])


def _rows(sorted_pieces):
    """(facts, iterator of pieces) of each row; the pieces are to be taken before the next row."""
    for key, group in groupby(sorted_pieces, lambda piece: piece[0][0]):
        yield key, next(group)[1], (value for _, value in group)


def partition_of(key) -> int:
    return zlib.crc32(key[0])


def assembled(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = SEED, chunk: int = CHUNK, partitions: int | None = None) -> RDD:
    """((row, place), value) in the order of the outputs, the pieces of a row together: facts, then the output's bytes in pieces.
    The number of partitions follows from the size of all texts, which a first pass adds up, and is at least that of Spark's shuffles."""

    def emit(index, rows):
        nth: dict[bytes, int] = {}
        for i, data in rows:
            data = bytes(data or b"")
            mark = hashlib.blake2b(f"{i}:".encode() + data, digest_size=8).digest()
            nth[mark] = nth.get(mark, 0) + 1
            yield from cut(index.to_bytes(4, "big") + mark + nth[mark].to_bytes(4, "big"), i, data, seed, chunk)

    if partitions is None:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-size // TASK_BYTES)))
    rows = docs.select(F.col(id), F.col(text).cast("binary")).rdd
    return rows.mapPartitionsWithIndex(emit).repartitionAndSortWithinPartitions(partitions, partition_of)


def texts(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars and the whole output of each row."""

    def join(pieces):
        for _, facts, parts in _rows(pieces):
            yield (*facts, b"".join(parts).decode())

    return _frame(docs, id, assembled(docs, id, text, **options).mapPartitions(join), "output")


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars and the digests of each row's output and of the text restored from output and form."""

    def fold(pieces):
        for key, facts, parts in _rows(pieces):
            digest, parted = hashlib.sha256(), Parted(facts[2])
            for data in parts:
                digest.update(data)
                for place, part in parted.take(data):
                    yield (key, place), part
            for place, part in parted.take(b"", last=True):
                yield (key, place), part
            yield (key, 0), (*facts, digest.hexdigest())

    def restore(pieces):
        for _, facts, parts in _rows(pieces):
            digest = hashlib.sha256()
            for part in parts:
                digest.update(part)
            yield (*facts, digest.hexdigest())

    outputs = assembled(docs, id, text, **options)
    in_text_order = outputs.mapPartitions(fold, preservesPartitioning=True).repartitionAndSortWithinPartitions(outputs.getNumPartitions(), partition_of)
    return _frame(docs, id, in_text_order.mapPartitions(restore), "output_sha256", "restored_sha256")


def restored(outputs: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """``outputs``, such as ``texts`` returns, with the text that each output was made from as column ``name``."""
    whole = {f: "^" + "".join(f"{MARKERS[p].decode()}(?<{p}>[\\s\\S]*)" for p in parts) + "$" for f, parts in FORMS.items() if parts}
    rebuilt = F.col(output)
    for f, parts in FORMS.items():
        if parts:
            rebuilt = F.when(F.col(form) == f, F.concat(*(F.regexp_extract(output, whole[f], parts.index(p) + 1) for p in TEXT))).otherwise(rebuilt)
    return outputs.withColumn(name, rebuilt)


def _frame(docs: DataFrame, id: str, rows: RDD, *more: str) -> DataFrame:
    facts = [StructField(id, docs.schema[id].dataType), StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType())]
    return docs.sparkSession.createDataFrame(rows, StructType(facts + [StructField(m, StringType()) for m in more]), verifySchema=False)


def op12_secondary_sort_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op12_secondary_sort_fill_middle": op12_secondary_sort_fill_middle}
ORACLE = {
    "op12_secondary_sort_fill_middle": f"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS k1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS k2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= {RATE} THEN 'plain'
         WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:least(k1, k2)], '') AS p, array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') AS m,
    array_to_string(u[greatest(k1, k2) + 1:], '') AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM p
"""
}
