"""Best-fit packing of tokenised documents into sequences by large-item matching.

Pieces longer than a third of the capacity ("large") meet at most twice in a sequence: going from the longest down, each
takes the longest large partner that still fits. Smaller pieces, from the longest down, go where the least room is left
over. Both steps depend on lengths only, so they are solved on the counts of each length: a plan of at most a few
thousand intervals whatever the number of documents. Pieces then get a rank within their length, and the plan turns
ranks into sequences and offsets.

Defined results: a null or empty text is the end id alone; documents over the capacity are cut into full pieces, the
first piece taking what is left over; repeated rows are pieces of their own (ties of length go by identifier, then
piece); rows with a null identifier, or with one that repeats, are documents of their own; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import Scratch, with_slots
from driftline.llm.tokens import Encoder

#: Documents that are encoded at once.
ROWS = 2000
#: Columns of a plan: pieces of ``length`` with ranks from ``rank`` on (``n`` of them) go to sequences from ``sequence`` on, at ``offset``.
PLAN = ("length", "rank", "n", "sequence", "offset")


class _Bins:
    """Ranges of sequences by the room they have left."""

    def __init__(self) -> None:
        self.by_room: dict[int, deque[list[int]]] = defaultdict(deque)
        self.count: dict[int, int] = defaultdict(int)
        self.rooms: list[int] = []

    def put(self, room: int, first: int, n: int) -> None:
        if not self.count[room]:
            heappush(self.rooms, room)
        self.by_room[room].append([first, n])
        self.count[room] += n

    def take(self, room: int, n: int) -> tuple[int, int]:
        """Up to ``n`` neighbouring sequences with that room."""
        first = self.by_room[room][0]
        got = min(n, first[1])
        out = (first[0], got)
        first[0] += got
        first[1] -= got
        if not first[1]:
            self.by_room[room].popleft()
        self.count[room] -= got
        return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """PLAN rows that place ``counts[length]`` pieces of each length (1 to capacity)."""
    out: list[tuple[int, int, int, int, int]] = []
    left = {k: int(v) for k, v in counts.items() if v}
    used: dict[int, int] = defaultdict(int)
    sequences = 0
    bins = _Bins()

    def place(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for length in large:
        while left[length]:
            # The longest partner that fits; a length may pair with itself.
            partner = next((k for k in large if k <= length and k + length <= capacity and left[k] > (k == length)), 0)
            n = left[length] if not partner else left[length] // 2 if partner == length else min(left[length], left[partner])
            first, sequences = sequences, sequences + n
            place(length, n, first, 0)
            if partner:
                place(partner, n, first, length)
            if room := capacity - length - partner:
                bins.put(room, first, n)

    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        skipped = []
        while left[length]:
            while bins.rooms and (bins.rooms[0] < length or not bins.count[bins.rooms[0]]):
                room = heappop(bins.rooms)
                if bins.count[room]:
                    skipped.append(room)
            if bins.rooms:
                room = bins.rooms[0]
                first, n = bins.take(room, left[length])
                if not bins.count[room]:
                    heappop(bins.rooms)
            else:
                per = capacity // length
                room, n = capacity, -(-left[length] // per)
                first, sequences = sequences, sequences + n
            place(length, n, first, capacity - room)
            if room > length:
                bins.put(room - length, first, n)
        bins.rooms = [r for r in {*bins.rooms, *skipped} if bins.count[r]]
        heapify(bins.rooms)
    return out


def place(pieces: DataFrame, capacity: int, scratch: Scratch, keys: list[str]) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of at most ``capacity``; ``keys`` name a piece."""
    # At most ``capacity`` rows, whatever the size of the table.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sorted(plan(counts, capacity))
    table = np.array(rows, dtype=np.int64).reshape(-1, len(PLAN))
    ranked = scratch.write("ranked", with_slots(pieces, ["length"], keys, "_rank", sum(counts.values())))
    stride = 1 << 44
    starts = table[:, 0] * stride + table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(starts, length.to_numpy(np.int64) * stride + rank.to_numpy(np.int64), side="right") - 1
        row = table[at]
        return pd.DataFrame({"sequence_id": row[:, 3] + rank.to_numpy(np.int64) - row[:, 1], "offset": row[:, 4]})

    return ranked.select("*", find("length", "_rank").alias("_to")).select(*pieces.columns, "_to.sequence_id", "_to.offset")


def cut(documents: DataFrame, tokenizer: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document with its end id."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, out = batch.slice(at, ROWS), []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)
                    n, start, piece = len(ids), 0, 0
                    size = n % capacity or capacity
                    while start < n:
                        out.append((doc, piece, start, size, zlib.crc32(ids[start : start + size])))
                        start, piece, size = start + size, piece + 1, capacity
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names)

    rows = documents.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(documents: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with the sequence and the offset each goes to."""
    scratch = Scratch(documents.sparkSession, "packing")
    pieces = scratch.write("pieces", cut(documents, tokenizer, capacity, end_id, key, text))
    return place(pieces, capacity, scratch, ["doc_id", "piece"])
