"""Operator 1: token-ID output in patched frame-of-reference (PFOR) files.

Documents are encoded, dealt out in ascending ``doc_id`` order (a range partitioning of the texts, so ids never
shuffle) and each task writes its run of documents as ``.pfor`` files:

* ids are cut into blocks of 128; a block keeps its minimum and the differences from it, packed at the width that
  holds ``percentile`` of its differences; the others leave their low bits there and their position and high bits
  in the exception lists;
* the index holds each block's minimum, width, first payload byte and first exception, and each document's first
  token, so any range of tokens can be read alone.

A task names its files afresh and reports them as rows, so only files of committed tasks count: a task that ran
twice or died leaves an orphan, never a wrong result. Files have at most ``file_tokens`` tokens plus one document.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ctxpress.llm.common import id_text, materialize, partitions, read, work_dir
from ctxpress.llm.encode import encoder, tokenizer_path

BLOCK = 128
MAGIC = b"PFORTOK1"
_HEAD = struct.Struct("<8s5Q")


def _pack(diff: np.ndarray, width: int) -> np.ndarray:
    """(n, 128) differences below 2**width -> (n, 16 * width) bytes."""
    if width == 0:
        return np.zeros((len(diff), 0), np.uint8)
    words, columns = np.zeros((2 * width, len(diff)), np.uint64), diff.T.astype(np.uint64)
    for i in range(BLOCK):
        at, shift = divmod(i * width, 64)
        words[at] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            words[at + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """The inverse of :func:`_pack`."""
    if width == 0:
        return np.zeros((len(packed), BLOCK), np.uint64)
    words = np.ascontiguousarray(packed).view("<u8").T.astype(np.uint64)
    out, mask = np.empty((BLOCK, len(packed)), np.uint64), np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        at, shift = divmod(i * width, 64)
        x = words[at] >> np.uint64(shift)
        if shift + width > 64:
            x = x | words[at + 1] << np.uint64(64 - shift)
        out[i] = x & mask
    return out.T


def pfor_encode(ids: np.ndarray, percentile: float = 0.9) -> dict[str, np.ndarray]:
    """uint32 ids -> the sections of a file; the last block is filled up with its own last id."""
    ids = np.asarray(ids, dtype=np.uint32)
    n_blocks = -(-len(ids) // BLOCK)
    full = np.pad(ids, (0, n_blocks * BLOCK - len(ids)), mode="edge" if len(ids) else "constant")
    blocks = full.reshape(n_blocks, BLOCK)
    low = blocks.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    diff = blocks - low[:, None]
    rank = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    chosen = np.partition(diff, rank, axis=1)[:, rank] if n_blocks else low
    width = np.ceil(np.log2(chosen.astype(np.float64) + 1)).astype(np.uint8)
    beyond = (diff >> width[:, None].astype(np.uint32)).astype(np.uint32)
    where, position = np.nonzero(beyond)
    sizes = width.astype(np.int64) * (BLOCK // 8)
    start = np.concatenate([[0], np.cumsum(sizes)])
    payload = np.zeros(int(start[-1]), np.uint8)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        if w:
            mask = np.uint32(0xFFFFFFFF >> (32 - w))
            payload[start[own][:, None] + np.arange(w * (BLOCK // 8))] = _pack(diff[own] & mask, w)
    return {
        "low": low.astype("<u4"),
        "width": width,
        "block_start": start.astype("<u8"),
        "exception_start": np.concatenate([[0], np.cumsum(np.bincount(where, minlength=n_blocks))]).astype("<u8"),
        "exception_position": position.astype(np.uint8),
        "exception_high": beyond[where, position].astype("<u4"),
        "payload": payload,
    }


def pfor_decode(s: dict[str, np.ndarray], first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` (not included), the filling of the last block included."""
    last = len(s["low"]) if last is None else last
    out, width, start = np.empty((last - first, BLOCK), np.uint32), s["width"][first:last], s["block_start"][first:last].astype(np.int64)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        out[own] = _unpack(s["payload"][start[own][:, None] + np.arange(w * (BLOCK // 8))], w)
    cut = s["exception_start"][first : last + 1].astype(np.int64)
    where = np.repeat(np.arange(last - first), np.diff(cut))
    position, high = s["exception_position"][cut[0] : cut[-1]], s["exception_high"][cut[0] : cut[-1]].astype(np.uint64)
    out[where, position] |= (high << width[where].astype(np.uint64)).astype(np.uint32)
    return (out + s["low"][first:last, None]).reshape(-1)


_SECTIONS = ("doc_id", "doc_null", "doc_start", "low", "width", "block_start", "exception_start", "exception_position", "exception_high", "payload")
_TYPES = dict(zip(_SECTIONS, ("<i8", "u1", "<u8", "<u4", "u1", "<u8", "<u8", "u1", "<u4", "u1"), strict=True))


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """One file: header, then the sections in the order of ``_SECTIONS``."""
    s = pfor_encode(ids, percentile)
    s["doc_id"] = np.array([d or 0 for d in doc_ids], "<i8")
    s["doc_null"] = np.array([d is None for d in doc_ids], "u1")
    s["doc_start"] = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    head = _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(s["low"]), len(s["exception_high"]), len(s["payload"]))
    return b"".join([head, *(np.ascontiguousarray(s[k], dtype=_TYPES[k]).tobytes() for k in _SECTIONS)])


def read_file(data: bytes) -> tuple[dict[str, np.ndarray], int]:
    """The sections of a file (views, no copies) and its number of tokens."""
    magic, docs, tokens, blocks, exceptions, payload = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a PFOR token file")
    counts = dict(zip(_SECTIONS, (docs, docs, docs + 1, blocks, blocks, blocks + 1, blocks + 1, exceptions, exceptions, payload), strict=True))
    at, s = _HEAD.size, {}
    for k in _SECTIONS:
        s[k] = np.frombuffer(data, _TYPES[k], counts[k], at)
        at += s[k].nbytes
    return s, tokens


def read_tokens(data: bytes, first: int, last: int) -> np.ndarray:
    """Tokens ``first`` to ``last`` of a file by its block index alone."""
    s, n = read_file(data)
    last = min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    a, b = first // BLOCK, -(-last // BLOCK)
    return pfor_decode(s, a, b)[first - a * BLOCK : last - a * BLOCK]


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


_MANIFEST = "part int, file int, path string, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, out: str, path: str | None = None, end_id: int = 2, file_tokens: int = 1 << 24, percentile: float = 0.9) -> DataFrame:
    """Writes ``docs`` (doc_id, text) as ``.pfor`` files under ``out``; gives the manifest: part, file, path, n_docs, n_tokens.

    Files in the order of (part, file) hold the documents by ascending doc_id (null first, equal ids by text). A
    null text is empty and holds only the end id. An empty table gives an empty manifest and no file.
    """
    path = path or tokenizer_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, file = TaskContext.get().partitionId(), 0
        doc_ids, lengths, raw, held = [], [], [], 0
        encode, end = encoder(path).encode, int(end_id).to_bytes(4, "little")

        def flush() -> pa.RecordBatch:
            nonlocal file, doc_ids, lengths, raw, held
            fs, folder = _fs(out)
            fs.create_dir(folder, recursive=True)
            name = f"{part:06d}-{file:04d}-{uuid.uuid4().hex}.pfor"
            ids = np.frombuffer(b"".join(raw), "<u4")
            with fs.open_output_stream(f"{folder}/{name}") as f:
                f.write(file_bytes(doc_ids, lengths, ids, percentile))
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "file": pa.array([file], pa.int32()), "path": [f"{out}/{name}"],
                "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_tokens": pa.array([held], pa.int64()),
            })
            file, doc_ids, lengths, raw, held = file + 1, [], [], [], 0
            return row

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4)
                raw.append(ids)
                held += lengths[-1]
                if held >= file_tokens:
                    yield flush()
        if doc_ids:
            yield flush()

    dealt = id_text(docs).repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    found = dealt.mapInArrow(write, _MANIFEST).collect()  # one small row a file
    return materialize(docs.sparkSession.createDataFrame(sorted(found), _MANIFEST), "manifest", out, 1)


def read_token_files(manifest: DataFrame, task_tokens: int = 1 << 21) -> DataFrame:
    """Reads the files of a manifest: doc_id, start (tokens of all documents before), n_tokens, ids_crc32, file_path.

    Whole files go to as many tasks as make about ``task_tokens`` each.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = _fs(row["path"])
                with fs.open_input_file(at) as f:
                    data = f.read()
                s, n = read_file(data)
                starts, null, lo = s["doc_start"].astype(np.int64), s["doc_null"], 0
                while lo < len(null):  # in runs of documents, so that memory holds a few blocks of ids
                    hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + (1 << 20))) - 1)
                    hi = min(hi, len(null))
                    ids = read_tokens(data, int(starts[lo]), int(starts[hi])).astype("<u4").tobytes()
                    cut = ((starts[lo : hi + 1] - starts[lo]) * 4).tolist()
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(s["doc_id"][lo:hi], pa.int64(), mask=null[lo:hi].astype(bool)),
                        "start": pa.array(starts[lo:hi] + row["base"], pa.int64()),
                        "n_tokens": pa.array(np.diff(starts[lo : hi + 1]), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(cut, cut[1:])], pa.int64()),
                        "file_path": pa.array([row["path"]] * (hi - lo), pa.string()),
                    })
                    lo = hi

    spark, files, at = manifest.sparkSession, [], 0
    for row in manifest.orderBy("part", "file").collect():  # one small row a file
        files.append((row["path"], at))
        at += row["n_tokens"]
    tasks = max(4, min(len(files), -(-at // task_tokens)))
    return spark.createDataFrame(files, "path string, base long").repartition(tasks).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, file_path string")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(read(spark, sf_dir, "documents"), work_dir(spark)))
