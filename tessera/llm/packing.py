"""Best-fit packing of tokenized documents into sequences of bounded length.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt evenly
over partitions of about ``PARTITION_PIECES``; each partition runs best-fit
decreasing and certifies its number of sequences against lower bounds by dual
feasible functions. Sequences with gaps give their pieces back: those of all
partitions are dealt anew over fewer partitions and packed again, until a round
saves no sequence or all the returned pieces have met in one partition. Only
lengths take part in this; the ids of a document are reduced to lengths and
checksums where its text is read.

Defined cases: a null or empty text has the end id alone; null document ids are
ids like any other; repeated rows are packed each by itself; an empty table has
no sequence; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_batches

CAPACITY = 4096
END_ID = 1
PARTITION_PIECES = 50_000
#: Share of a sequence that must be free for its pieces to be dealt anew, where
#: the partition's count is certified and where it is not.
GAP_CERTIFIED, GAP_OPEN = 0.10, 0.01
#: Words that a worker keeps the ids of, twice that many at most.
CACHE_WORDS = 400_000
#: Longer texts are cut into words bit by bit; texts of a batch are taken in lots of so many characters.
LONG_TEXT = 4 << 20

PIECES = "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint"


class WordTokenizer:
    """Ids of a text by a tokenizer file whose pre-tokenizer cuts the lower-cased,
    composed text into words that are encoded one by one. Words of texts in Latin
    letters are found here, and the ids of ``CACHE_WORDS`` of them are kept; every
    other text goes to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # up to here, the lower case of a letter is one of these letters, and composed
        latin = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x180)) if c != 0x130]
        letters = "".join(x for x in latin if unicodedata.category(x)[0] == "L")
        numbers = "".join(x for x in latin if unicodedata.category(x)[0] == "N")
        self.other = re.compile(f"[^{re.escape(''.join(latin))}]|<\\|")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def bytes_of(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Have the ids of all ``words`` in ``new``; what was not asked for lately goes."""
        words = words.difference(self.new)
        if len(self.new) + len(words) > CACHE_WORDS:
            self.old, self.new = self.new, {}
        for w in words.intersection(self.old):
            self.new[w] = self.old[w]
        unknown = list(words.difference(self.old))
        for w, e in zip(unknown, self.library.encode_batch(unknown, add_special_tokens=False)):
            self.new[w] = self.bytes_of(e.ids)

    def _joined(self, words: list[str]) -> bytes:
        try:
            return b"".join(map(self.new.__getitem__, words))
        except KeyError:  # a turn of the cache since they were learnt
            self._learn(set(words))
            return b"".join(map(self.new.__getitem__, words))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        found: list[list[str] | None] = [None if len(t) > LONG_TEXT or self.other.search(t) else self.words.findall(t.lower()) for t in texts]
        self._learn(set().union(*(x for x in found if x)))
        for text, words in zip(texts, found):
            if words is not None:
                yield self._joined(words)
            elif self.other.search(text):
                yield self.bytes_of(self.library.encode(text, add_special_tokens=False).ids)
            else:
                matches, out = self.words.finditer(text.lower()), []
                while part := [m[0] for m in islice(matches, 1 << 16)]:
                    self._learn(set(part))
                    out.append(self._joined(part))
                yield b"".join(out)

    def __call__(self, text: str) -> bytes:
        return next(self.encode([text]))


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, checksum) of each piece of a document."""
    n = len(ids) // 4
    return [(k, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)])) for k, s in enumerate(range(0, n, capacity))]


def tokenize(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the ids of a text and ``END_ID``, cut where they exceed
    ``capacity``. The id column comes as a string."""
    small_batches(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, end = WordTokenizer(tokenizer), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            texts = [x if isinstance(x, str) else "" for x in batch["text"]]
            lots, held = [0], 0
            for i, x in enumerate(texts):
                if held > LONG_TEXT:
                    lots.append(i)
                    held = 0
                held += len(x)
            rows = []
            for a, b in zip(lots, [*lots[1:], len(texts)]):
                for key, ids in zip(batch["doc_id"].iloc[a:b], tokens.encode(texts[a:b])):
                    rows += [(key, *piece) for piece in cut(ids + end, capacity)]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int, steps: int = 32) -> int:
    """The largest of the bounds by dual feasible functions: items above
    capacity - e count whole and items below e nothing, for every e; and the
    rounding functions floor((k + 1) x) / k, for k up to ``steps``."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    number, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * np.arange(capacity + 1))])
    e = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - e + 1]
    middle = total[capacity - e + 1] - total[e]
    best = int((large + -(-middle // capacity)).max())
    x = np.arange(capacity + 1, dtype=np.int64)
    for k in range(1, steps + 1):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)
        best = max(best, int(-(-int((counts * value).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the free room of each bin; the items must
    come in decreasing order."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has r tokens of room
    room: list[int] = []
    for i, n in enumerate(lengths.tolist()):
        fits = rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            held = by_room[r]
            b = held.pop()
            if not held:
                rooms &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        r -= n
        room[b] = r
        if r:
            by_room.setdefault(r, []).append(b)
            rooms |= 1 << r
    return bins, offsets, np.array(room, dtype=np.int64)


PACKED = PIECES + ", sequence_id bigint, offset bigint, gap boolean"


def _pack(capacity: int, turn: int):
    """Packs a whole partition of pieces and certifies its count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True).sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        certified = len(room) == lower_bound(lengths, capacity)
        gap = room >= capacity * (GAP_CERTIFIED if certified else GAP_OPEN)
        rows["sequence_id"] = (turn << 48) + (TaskContext.get().partitionId() << 24) + bins  # fewer bins than a partition has pieces
        rows["offset"], rows["gap"] = offsets, gap[bins]
        yield rows

    return run


def pack_pieces(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    names = [c.split()[0] for c in PIECES.split(", ")]
    parts = lambda n: max(1, math.ceil(n / PARTITION_PIECES))
    deal = lambda rows, n, turn: materialize(spark, rows.select(*names).repartition(parts(n)).mapInPandas(_pack(capacity, turn), PACKED), f"packing-{turn}")
    n = pieces.count()
    current, done, before = deal(pieces, n, 0), [], None
    for turn in count(1):  # ends by itself: every round saves a sequence
        gaps = current.where("gap")
        left, sequences = gaps.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        if not left or (before == 1):
            break
        again = deal(gaps, left, turn)
        if again.agg(F.count_distinct("sequence_id")).first()[0] >= sequences:
            break
        done.append(current.where("not gap"))
        current, before = again, parts(left)
    for rows in done:
        current = current.unionAll(rows)
    return current.drop("gap")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with the sequence it is in and its place there."""
    pieces = materialize(spark, tokenize(spark, docs, tokenizer, capacity, id_col, text_col), "pieces")
    kind = docs.schema[id_col].dataType.simpleString()
    return pack_pieces(spark, pieces, capacity).withColumn("doc_id", F.col("doc_id").cast(kind)).withColumnRenamed("doc_id", id_col)
