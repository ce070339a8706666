"""Length-delimited binary records of token ids, with an offset index for shuffled reads.

A record file is a row of frames: length (u64), masked checksum of those eight bytes (u32), data, masked checksum of the
data (u32), all little-endian. Data is the key (i64), the width of an id in bytes (u8: 2 or 4) and the ids. The mask is
``rotate_right(crc32, 15) + 0xA282EAD8``. Beside each record file lies an index file: for each record key (i64), byte
offset (u64), frame length (u64) and number of ids (u64); so any record is read by one seek.

Files go to a folder that executors share, under names of their own for each attempt; the manifest, a Parquet table that
Spark commits, names the files that count. So a lost executor leaves files nobody reads, never a torn data set.

Defined results: null and empty texts are records of the end id alone; equal keys lie side by side; a null key is written as
-2^63, so it comes first and is read back as null; an empty table makes an empty manifest; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import Scratch, partitions, small_batches
from driftline.llm.tokens import Encoder

HEAD = struct.Struct("<QI")
KEY = struct.Struct("<qB")
INDEX = struct.Struct("<qQQQ")
_MASK = 0xA282EAD8

#: Documents that are encoded at once.
ROWS = 2000
#: Stands for a null key.
NO_KEY = -(1 << 63)
#: Files whose counts are summed at once.
FILES = 1024

MANIFEST = "part long, records_file string, index_file string, n_records long, n_tokens long, first_key long, last_key long, bytes long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return b"".join((length, struct.pack("<I", masked(length)), data, struct.pack("<I", masked(data))))


def unframe(buffer: bytes, at: int) -> tuple[bytes, int]:
    """The data of the frame at ``at``, and where the next one begins; raises ValueError on damage."""
    if at + HEAD.size > len(buffer):
        raise ValueError("a frame is cut off")
    length, check = HEAD.unpack_from(buffer, at)
    if masked(buffer[at : at + 8]) != check:
        raise ValueError("a length is damaged")
    begin = at + HEAD.size
    data = bytes(buffer[begin : begin + length])
    if len(data) < length or begin + length + 4 > len(buffer):
        raise ValueError("a frame is cut off")
    if masked(data) != struct.unpack_from("<I", buffer, begin + length)[0]:
        raise ValueError("data are damaged")
    return data, begin + length + 4


def serialise(key: int, ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit."""
    wide = len(ids) and ids.max() > 0xFFFF
    return KEY.pack(key, 4 if wide else 2) + ids.astype("<u4" if wide else "<u2").tobytes()


def deserialise(data: bytes) -> tuple[int, np.ndarray]:
    key, width = KEY.unpack_from(data)
    return key, np.frombuffer(data, f"<u{width}", offset=KEY.size).astype("<u4")


def index_entry(key: int, at: int, size: int, n: int) -> bytes:
    return INDEX.pack(key, at, size, n)


def read_records(store, records: str, index: str) -> Iterator[tuple[int, np.ndarray]]:
    """(key, ids) of every record of a file, in order, checked against the index."""
    with store.open_input_stream(index) as src:
        entries = list(INDEX.iter_unpack(src.read()))
    with store.open_input_stream(records) as src:
        for key, _, size, n in entries:
            doc, ids = deserialise(unframe(src.read(size), 0)[0])
            if doc != key or len(ids) != n:
                raise ValueError("index and records differ")
            yield doc, ids


def read_record(store, records: str, index: str, k: int) -> tuple[int, np.ndarray]:
    """Record ``k`` of a file alone, by one seek in the index and one in the records."""
    with store.open_input_file(index) as src:
        src.seek(k * INDEX.size)
        _, at, size, _ = INDEX.unpack(src.read(INDEX.size))
    with store.open_input_file(records) as src:
        src.seek(at)
        return deserialise(unframe(src.read(size), 0)[0])


def _store(folder: str):
    """pyarrow's file system and path of a folder given as a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write(documents: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Encodes every document and writes record and index files in ascending order of ``key``; returns the manifest."""
    spark = documents.sparkSession
    names = [c.split()[0] for c in MANIFEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        store, base = _store(folder)
        name, sink, at, tokens, keys, index = f"part-{part:06d}-{uuid.uuid4().hex}", None, 0, 0, [], []
        for batch in batches:
            if sink is None and batch.num_rows:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(f"{base}/{name}.rec")
            for first in range(0, batch.num_rows, ROWS):
                own = batch.slice(first, ROWS)
                for doc, ids in zip(own.column(0).to_pylist(), encoder.encode(own.column(1)), strict=True):
                    framed = frame(serialise(doc, np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)))
                    sink.write(framed)
                    index.append(index_entry(doc, at, len(framed), len(ids) + 1))
                    at, tokens = at + len(framed), tokens + len(ids) + 1
                    keys = [keys[0] if keys else doc, doc]
        if sink is not None:
            sink.close()
            with store.open_output_stream(f"{base}/{name}.idx") as out:
                out.write(b"".join(index))
            row = (part, f"{name}.rec", f"{name}.idx", len(index), tokens, *keys, at)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names)

    rows = documents.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    ordered = rows.repartitionByRange(parts or partitions(spark, documents), "id").sortWithinPartitions("id")
    made = ordered.mapInArrow(run, MANIFEST)
    with small_batches(spark):
        made.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every record, checked; ``start`` counts the ids of all records before it."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn("group", F.floor(F.col("part") / FILES))
    # Ids before a file: those of the groups of files before its own (the driver sees one row for FILES files), and of the files before it in the group.
    groups = manifest.groupBy("group").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("files")).orderBy("group").collect()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    if not groups:
        return spark.createDataFrame([], schema)
    begins = np.cumsum([0, *[g["n"] for g in groups]]).tolist()
    bases = F.broadcast(spark.createDataFrame([(g["group"], b) for g, b in zip(groups, begins, strict=False)], "group long, base long"))
    before = F.sum("n_tokens").over(Window.partitionBy("group").orderBy("part")) - F.col("n_tokens")
    todo = manifest.withColumn("before", before).join(bases, "group").select("records_file", "index_file", (F.col("base") + F.col("before")).alias("start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)
        for batch in batches:
            for records, index, start in batch.itertuples(index=False):
                out, held = [], 0
                for doc, ids in read_records(store, f"{base}/{records}", f"{base}/{index}"):
                    raw = ids.tobytes()
                    out.append((None if doc == NO_KEY else doc, start, len(ids), zlib.crc32(raw), raw))
                    start, held = start + len(ids), held + len(raw)
                    if held > 8 << 20:
                        yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
                        out, held = [], 0
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    return todo.repartition(sum(g["files"] for g in groups), "records_file").mapInPandas(run, schema)


def round_trip(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes a data set in a scratch folder and reads it back."""
    scratch = Scratch(documents.sparkSession, "records")
    write(documents, f"{scratch.path}/set", tokenizer, end_id)
    return read(documents.sparkSession, f"{scratch.path}/set")
