"""Token ids in training order, as binary shards.

The texts' ids, each text followed by an end id, make one stream in table order, cut in
sequences of ``length`` ids. A keyed Feistel permutation with cycle-walking gives each
sequence a global slot; slots are laid out in shard files of fixed stride, so slot s is at byte
``(s % per_shard) * stride`` of shard ``s // per_shard``, and a reader seeks to any slot and
reads on sequentially. The last sequence of the stream is padded.

Ids are either the bytes of a text column (0..255; byte 255 never occurs in UTF-8 and ends a
text, 254 pads) or an array column of integers with given end and pad ids.

Plan. A light first scan (ids counted in the JVM) yields one row per input split; their sums
give each split its place in the stream. The second scan cuts the pieces, computes their
slots, and shuffles them once, straight to the range of shards that each partition writes
(``repartitionById``); pieces travel compressed, as shuffle and shards share the disk. Inside a partition the sort spills, and rows are streamed to the file.
The input is a Parquet table: its splits are pinned for both scans by a fixed minimum number
of partitions, and a split that has moved stops the job. Every shard is verified while it is
written: each slot must come exactly once and be full. A task writes to a name of its own and
renames at the end, so a lost executor leaves no half shard, and a repeated task writes the
same bytes.

Defined cases: a null or empty text is an end id alone; repeated ids and rows are separate
texts; an empty table gives no shards and an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.llm.common import store
from trolley.session import ensure_checkpoint_dir, shuffle_partitions

LENGTH, PER_SHARD, KEY, ROUNDS, SQUEEZE = 2048, 1 << 14, 0x5EED, 6, 3
BYTE_END, BYTE_PAD = 255, 254
_MIN_PARTS = "spark.sql.files.minPartitionNum"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Keyed bijection of 0..n-1: a balanced Feistel network over the next even power of two, walked until inside."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & ((1 << 64) - 1)))
    out = np.asarray(index).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for k in (keys[::-1] if inverse else keys):
            if inverse:
                left, right = right ^ (_mix(left + k) & mask), left
            else:
                left, right = right, left ^ (_mix(right + k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _payload(value, dtype: np.dtype, end: int) -> bytes:
    if value is None:
        data = b""
    elif isinstance(value, str):
        data = value.encode("utf-8", "surrogatepass")
    else:
        data = np.asarray(value, dtype).tobytes()
    return data + np.array([end], dtype).tobytes()


def write_shards(spark: SparkSession, table_path: str, out_dir: str | None = None, id_col: str = "doc_id", ids_col: str = "text", length: int = LENGTH,
                 per_shard: int = PER_SHARD, key: int = KEY, dtype: str = "uint8", end: int = BYTE_END, pad: int = BYTE_PAD) -> tuple[DataFrame, dict]:
    """Write the shards of a Parquet table; (a row per sequence, the parameters that a reader needs).

    Rows: seq (place in the stream), slot, shard, byte_offset, n_ids, doc_ids, crc32 of the stride.
    """
    out_dir = out_dir or f"{ensure_checkpoint_dir(spark).rstrip('/')}/training-order/{uuid.uuid4().hex}"
    kind = np.dtype(dtype)
    before = spark.conf.get(_MIN_PARTS, None)
    spark.conf.set(_MIN_PARTS, before or str(spark.sparkContext.defaultParallelism))
    try:
        docs = spark.read.parquet(table_path)
        is_text = dict(docs.dtypes)[ids_col] in ("string", "binary")
        if is_text and kind.itemsize != 1:
            raise ValueError("a text column is written as bytes")
        rows = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), F.col(id_col).cast("bigint").alias("doc"),
                           F.col(ids_col).alias("ids"))
        size = F.coalesce(F.octet_length("ids") if is_text else F.size("ids"), F.lit(0)).cast("bigint") + 1
        splits = rows.select("file", "at", size.alias("n")).mapInArrow(_measure, "file string, at bigint, n bigint").collect()  # a row per input split
        splits.sort(key=lambda r: (r["file"], r["at"]))
        stops = np.cumsum([r["n"] for r in splits], dtype=np.int64) if splits else np.zeros(0, np.int64)
        base = {(r["file"], r["at"]): int(stop - r["n"]) for r, stop in zip(splits, stops)}
        total = int(stops[-1]) if splits else 0
        n = -(-total // length)
        spec = {"dir": out_dir, "sequences": n, "ids": total, "length": length, "per_shard": per_shard, "key": key, "dtype": dtype, "end": end, "pad": pad}
        shards = max(1, -(-n // per_shard))
        parts = min(shards, max(1, shuffle_partitions(spark) * 4))
        width, stride = kind.itemsize, length * kind.itemsize
        shared = spark.sparkContext.broadcast(base)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, squeeze = None, zstandard.ZstdCompressor(level=SQUEEZE, write_checksum=False).compress
            for batch in batches:
                if place is None and batch.num_rows:
                    place = shared.value.get((batch.column(0)[0].as_py(), batch.column(1)[0].as_py()))
                    if place is None:
                        raise RuntimeError("the input's splits moved between the scans; run again")
                seq, start, data, doc, held = [], [], [], [], 0
                ids = batch.column(2).to_pylist()
                for i, value in enumerate(batch.column(3)):
                    payload = memoryview(_payload(value.as_py(), kind, end))
                    at, stop = place, place + len(payload) // width
                    while at < stop:
                        to = min(stop, (at // length + 1) * length)
                        seq.append(at // length)
                        start.append(at % length)
                        data.append(squeeze(payload[(at - place) * width:(to - place) * width]))
                        doc.append(ids[i])
                        held += to - at
                        at = to
                    place = stop
                    if held > 1 << 22:
                        yield _pieces(seq, start, data, doc, n, key)
                        seq, start, data, doc, held = [], [], [], [], 0
                if seq:
                    yield _pieces(seq, start, data, doc, n, key)

        pieces = rows.mapInArrow(cut, "slot bigint, seq bigint, start int, doc bigint, data binary")
        target = (F.floor(F.col("slot") / per_shard) * parts / shards).cast("int")
        placed = pieces.repartitionById(parts, target).sortWithinPartitions("slot", "start")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, root = pafs.FileSystem.from_uri(out_dir)
            files.create_dir(root, recursive=True)
            out, stream, temp, shard, due = [], None, "", -1, None

            def close() -> None:
                nonlocal stream
                if stream is not None:
                    if due != min((shard + 1) * per_shard, n):
                        raise RuntimeError(f"shard {shard} is not full")
                    stream.close()
                    files.move(temp, f"{root}/shard-{shard:07d}.bin")
                    stream = None

            def finish(slot: int, seq: int, parts_of: list[bytes], docs_of: list) -> None:
                nonlocal stream, temp, shard, due
                block = b"".join(parts_of)
                got = len(block) // width
                if got != (length if seq < n - 1 else total - (n - 1) * length):
                    raise RuntimeError(f"slot {slot} is not whole")
                block += np.full(length - got, pad, kind).tobytes()
                if slot // per_shard != shard:
                    close()
                    shard, due = slot // per_shard, slot // per_shard * per_shard
                    temp = f"{root}/.shard-{shard:07d}-{uuid.uuid4().hex}"
                    stream = files.open_output_stream(temp)
                if slot != due:
                    raise RuntimeError(f"slot {due} is missing or came twice")
                stream.write(block)
                due += 1
                out.append((seq, slot, shard, (slot % per_shard) * stride, got, docs_of, zlib.crc32(block)))

            now, seq_now, parts_of, docs_of, next_start = -1, -1, [], [], 0
            expand = zstandard.ZstdDecompressor().decompress
            for batch in batches:
                for slot, seq, start, doc, data in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    if slot != now:
                        if now >= 0:
                            finish(now, seq_now, parts_of, docs_of)
                        now, seq_now, parts_of, docs_of, next_start = slot, seq, [], [], 0
                    if start != next_start:
                        raise RuntimeError(f"slot {slot} has a gap")
                    parts_of.append(expand(data))
                    next_start = start + len(parts_of[-1]) // width
                    if doc is not None and (not docs_of or docs_of[-1] != doc):
                        docs_of.append(doc)
                if len(out) > 10_000:
                    yield _manifest(out)
                    out.clear()
            if now >= 0:
                finish(now, seq_now, parts_of, docs_of)
            close()
            if out:
                yield _manifest(out)

        done = store(placed.mapInArrow(write, "seq bigint, slot bigint, shard bigint, byte_offset bigint, n_ids bigint, doc_ids array<bigint>, crc32 bigint"))
    finally:
        if before is None:
            spark.conf.unset(_MIN_PARTS)
        else:
            spark.conf.set(_MIN_PARTS, before)
    if n:
        files, root = pafs.FileSystem.from_uri(out_dir)
        with files.open_output_stream(f"{root}/order.json") as f:
            f.write(json.dumps(spec).encode())
    return done, spec


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the split: its first row's file and place, and its ids."""
    first, total = None, 0
    for batch in batches:
        if batch.num_rows:
            first = first or (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
            total += int(batch.column(2).to_numpy().sum())
    if first:
        yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]]), pa.array([total])], ["file", "at", "n"])


def _pieces(seq: list, start: list, data: list, doc: list, n: int, key: int) -> pa.RecordBatch:
    at = np.array(seq, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(permute(at, n, key)), pa.array(at), pa.array(start, pa.int32()), pa.array(doc, pa.int64()),
                                       pa.array(data, pa.binary())], ["slot", "seq", "start", "doc", "data"])


def _manifest(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out))
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["seq", "slot", "shard", "byte_offset", "n_ids", "doc_ids", "crc32"])


def read_slots(spec: dict, first: int, count: int) -> Iterator[np.ndarray]:
    """Sequences of the slots from ``first`` on, read sequentially; a reader resumes by the next slot."""
    files, root = pafs.FileSystem.from_uri(spec["dir"])
    stride = spec["length"] * np.dtype(spec["dtype"]).itemsize
    slot, stop = first, min(first + count, spec["sequences"])
    while slot < stop:
        shard = slot // spec["per_shard"]
        until = min(stop, (shard + 1) * spec["per_shard"])
        with files.open_input_file(f"{root}/shard-{shard:07d}.bin") as f:
            f.seek((slot - shard * spec["per_shard"]) * stride)
            for _ in range(slot, until):
                yield np.frombuffer(f.read(stride), spec["dtype"])
        slot = until
