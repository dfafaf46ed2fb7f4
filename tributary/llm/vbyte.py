"""Token ids in a byte-aligned variable-length format with separate control bytes.

A *segment* is a self-contained file image: header, rank table, document ids, document lengths, control bytes, data
bytes. Ids are replaced by their frequency rank in the segment, so frequent tokens take one byte; each control byte
holds the lengths (1 to 4 bytes) of four ranks. Decoding looks control bytes up in a 256 x 4 table of lengths and
gathers the data bytes with array operations.

Segments are rows of Parquet in the shared folder, so Spark's commit protocol covers lost executors. Documents are in
ascending doc_id order over (shard, segment). A null text is empty; null doc_ids come first; equal doc_ids keep one
another's company in order of a hash of their text, and may be cut anywhere, so that no id is gathered; each document ends with
`end_id`. A very long text makes its segment larger. Extra columns are ignored, whatever their names. An empty table gives no rows.
`export` writes each image to a file of its own.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"TVB1"
#: Lengths of the four values behind each control byte.
LENGTHS = np.array([[1 + (c >> (2 * i) & 3) for i in range(4)] for c in range(256)], np.int64)
SEGMENT_IDS = 4_000_000
STORED = "shard int, segment int, n_docs int, n_ids long, image binary"
READ = "doc_id long, shard int, segment int, place int, local_start long, n_tokens long, ids_crc32 long"


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    end = np.cumsum(size)
    data = np.empty(int(end[-1]) if len(v) else 0, np.uint8)
    begin = end - size
    data[begin] = v & 0xFF
    for i in range(1, 4):
        more = np.flatnonzero(size > i)
        if len(more):
            data[begin[more] + i] = v[more] >> np.uint32(8 * i) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


def unpack_values(control: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """The n values and how many data bytes they took."""
    size = LENGTHS[control].reshape(-1)[:n]
    end = np.cumsum(size)
    begin = end - size
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    out = padded[begin].astype(np.uint32)
    for i in range(1, 4):
        more = np.flatnonzero(size > i)
        if len(more):
            out[more] |= padded[begin[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out, int(end[-1]) if n else 0


def write_segment(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """The file image of documents whose ids lie end to end."""
    count = np.bincount(ids, minlength=1)
    order = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
    rank = np.zeros(len(count), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    control, data = pack_values(rank[ids])
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = np.array([len(doc_ids), len(ids), len(order), len(data)], "<u8")
    return b"".join([MAGIC, head.tobytes(), order.astype("<u4").tobytes(), null.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), sizes.astype("<u4").tobytes(), control, data])


def read_segment(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids."""
    if image[:4] != MAGIC:
        raise ValueError("not a token segment")
    docs, n, ranks, data = map(int, np.frombuffer(image, "<u8", 4, 4))
    at = 36
    table = np.frombuffer(image, "<u4", ranks, at)
    null = np.frombuffer(image, np.uint8, docs, at := at + 4 * ranks)
    doc_ids = np.frombuffer(image, "<i8", docs, at := at + docs).tolist()
    sizes = np.frombuffer(image, "<u4", docs, at := at + 8 * docs).astype(np.int64)
    control = np.frombuffer(image, np.uint8, -(-n // 4), at := at + 4 * docs)
    values, used = unpack_values(control, np.frombuffer(image, np.uint8, data, at + len(control)), n)
    if used != data or sizes.sum() != n or at + len(control) + data != len(image):
        raise ValueError("damaged token segment")
    return [None if x else d for x, d in zip(null, doc_ids, strict=True)], sizes, table[values] if n else values


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts and write the segments; returns the written table (columns STORED)."""
    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("image", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, shard, segment = tokens.encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        doc_ids, sizes, ids, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            image = write_segment(doc_ids, np.concatenate(sizes), flat)
            return pa.RecordBatch.from_pylist([{"shard": shard, "segment": segment, "n_docs": len(doc_ids), "n_ids": len(flat), "image": image}], schema)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            names = batch.column(0).to_pylist()
            for a, b in tokens.chunks([len(t) for t in texts], tokens.CHUNK_CHARS):
                got, bounds = encode(texts[a:b])
                doc_ids += names[a:b]
                sizes.append(np.diff(bounds) + 1)
                ids.append(np.insert(got, bounds[1:], end_id).astype(np.uint32))
                held += len(ids[-1])
                if held >= SEGMENT_IDS:
                    yield flush()
                    doc_ids, sizes, ids, held, segment = [], [], [], 0, segment + 1
        if doc_ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # equal ids, and equal rows, may fall into several ranges
    dealt = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("nth"))
    keys = ["doc_id", "h", "nth"]
    return common.saved(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text").mapInArrow(run, STORED), "segments", "none")


def export(stored: DataFrame, folder: str) -> DataFrame:
    """Writes each segment as a file of the format, {folder}/{shard}-{segment}.tvb, from the executors; folder is shared by all.

    A file appears whole or not at all, and a repeated task writes the same bytes. Returns path and n_bytes of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        for batch in batches:
            for k in range(batch.num_rows):
                name = f"{root}/{batch.column(0)[k].as_py():06d}-{batch.column(1)[k].as_py():04d}.tvb"
                image, part = batch.column(2)[k].as_py(), f"{name}.{uuid.uuid4().hex}.part"
                with target.open_output_stream(part) as out:
                    out.write(image)
                target.move(part, name)
                yield pa.RecordBatch.from_pylist([{"path": name, "n_bytes": len(image)}], pa.schema([("path", pa.string()), ("n_bytes", pa.int64())]))

    return stored.select("shard", "segment", "image").mapInArrow(run, "path string, n_bytes long")


def read(stored: DataFrame) -> DataFrame:
    """Per document, from the stored segments: doc_id, start, n_tokens, ids_crc32, shard, segment."""
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("segment", pa.int32()), ("place", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one image at a time
                shard, segment = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                doc_ids, sizes, ids = read_segment(batch.column(2)[k].as_py())
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                bounds = [0, *(4 * ends).tolist()]
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([shard] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], schema=schema)

    # offsets of segments from the file's own counts: within a shard, then over shards (as many rows as partitions)
    sizes = stored.select("shard", "segment", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inner = sizes.select("shard", "segment", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids")).alias("segment_start"))
    base = inner.join(shards, "shard").select("shard", "segment", (F.col("shard_start") + F.col("segment_start")).alias("base"))
    found = stored.select("shard", "segment", "image").mapInArrow(run, READ)
    return found.join(base, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "shard", "segment")


def op6_token_vbyte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the format and back, with ids of byte_bpe_50k.json and end id 0."""
    return read(write(common.table(spark, sf_dir, "documents"), tokens.vocabulary(), 0))
