"""Binary token files: concatenated ids with Elias-Fano coded document boundaries.

A shard file holds, in this order: the ids of its documents one after the other (2 or 4 bytes each,
little-endian), the block of boundaries, the block of document identifiers (sorted), and a
footer of fixed size. Both blocks are Elias-Fano sequences: the low bits of each value in a
packed array, the high bits in unary, and a directory that holds the number of ones before each
512 bits of the unary part; ``get`` selects in it, so no table of 64-bit offsets is kept.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialize, running_total, shared_path
from codeloom.llm.tokenizing import encoder

MAGIC = b"CLTOKEN1"
SUPER = 512  # bits of the unary part for each entry of the directory
FOOTER = struct.Struct("<8sBQQQqQQ")  # magic, id bytes, ids, documents, null ids, least id, start of either block


def _pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after the other, least bit first."""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


class EliasFano:
    """A non-decreasing sequence of integers from 0 on, in about 2 + log2(largest / count) bits each."""

    HEAD = struct.Struct("<QBQQ")  # count, low bits, bytes of low part, bytes of unary part

    def __init__(self, raw: bytes):
        self.count, self.width, lows, highs = self.HEAD.unpack_from(raw)
        at = self.HEAD.size
        self.low = np.frombuffer(raw, np.uint8, lows, at)
        self.high = np.frombuffer(raw, np.uint8, highs, at + lows)
        blocks = -(-highs * 8 // SUPER)
        self.directory = np.frombuffer(raw, "<u4", blocks, at + lows + highs)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(ones[-1]) + 1 if n else 0), np.uint8)
        unary[ones] = 1
        low, high = _pack(values, width) if width else b"", np.packbits(unary, bitorder="little").tobytes()
        starts = np.arange(-(-len(high) * 8 // SUPER)) * SUPER
        directory = np.searchsorted(ones, starts).astype("<u4").tobytes()
        return cls.HEAD.pack(n, width, len(low), len(high)) + low + high + directory

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.width:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.width, last * self.width
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        return bits.reshape(-1, self.width).astype(np.uint64) @ (np.uint64(1) << np.arange(self.width, dtype=np.uint64))

    def slice(self, first: int, last: int) -> np.ndarray:
        """Values first to last - 1; reads only the directory and the bits that hold them."""
        if last <= first:
            return np.zeros(0, np.uint64)
        begin = int(np.searchsorted(self.directory, first, "right")) - 1
        end = int(np.searchsorted(self.directory, last - 1, "right"))
        bits = np.unpackbits(self.high[begin * SUPER // 8 : end * SUPER // 8], bitorder="little")
        ones = np.flatnonzero(bits) + begin * SUPER
        skip = first - int(self.directory[begin])
        highs = (ones[skip : skip + last - first] - np.arange(first, last)).astype(np.uint64)
        return (highs << np.uint64(self.width)) | self._lows(first, last)

    def get(self, i: int) -> int:
        """Select: value i."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        return int(self.slice(i, i + 1)[0])

    def __len__(self) -> int:
        return self.count


def _open(uri: str):
    from pyarrow import fs

    if "://" not in uri:
        uri = "file:" + uri if uri.startswith("/") else uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Streams one shard; only lengths and identifiers stay in memory. A file appears when it is whole."""

    def __init__(self, uri: str, id_bytes: int):
        self.fs, self.path = _open(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{np.random.default_rng().integers(1 << 62):x}"
        self.out = self.fs.open_output_stream(self.part)
        self.id_bytes, self.lengths, self.ids, self.nulls = id_bytes, [], [], 0

    def add(self, doc_id: int | None, tokens: bytes) -> None:
        if doc_id is None:
            self.nulls += 1
        else:
            self.ids.append(doc_id)
        self.lengths.append(len(tokens) // self.id_bytes)
        self.out.write(tokens)

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        bounds = np.zeros(len(self.lengths) + 1, np.int64)
        np.cumsum(self.lengths, out=bounds[1:])
        least = self.ids[0] if self.ids else 0
        starts = EliasFano.encode(bounds)
        names = EliasFano.encode(np.array([x - least for x in self.ids], np.uint64))
        total = int(bounds[-1])
        self.out.write(starts + names)
        at = total * self.id_bytes
        self.out.write(FOOTER.pack(MAGIC, self.id_bytes, total, len(self.lengths), self.nulls, least, at, at + len(starts)))
        self.out.close()
        self.fs.move(self.part, self.path)
        return len(self.lengths), total


class ShardReader:
    """Random and sequential access to one shard file."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, self.id_bytes, self.n_ids, self.n_docs, self.nulls, self.least, at, names = FOOTER.unpack(
            self._read(size - FOOTER.size, FOOTER.size)
        )
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.bounds = EliasFano(self._read(at, names - at))
        self.names = EliasFano(self._read(names, size - FOOTER.size - names))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        found = self.names.slice(max(0, first - self.nulls), max(0, last - self.nulls))
        return [None] * (min(last, self.nulls) - min(first, self.nulls)) + [int(x) + self.least for x in found]

    def tokens(self, i: int) -> np.ndarray:
        """The ids of document i of the shard."""
        a, b = (int(x) for x in self.bounds.slice(i, i + 2))
        return np.frombuffer(self._read(a * self.id_bytes, (b - a) * self.id_bytes), f"<u{self.id_bytes}")

    def documents(self, chunk: int = 1024) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start in the shard and ids of each document."""
        for first in range(0, self.n_docs, chunk):
            last = min(first + chunk, self.n_docs)
            bounds = self.bounds.slice(first, last + 1).astype(np.int64)
            raw = self._read(int(bounds[0]) * self.id_bytes, int(bounds[-1] - bounds[0]) * self.id_bytes)
            ids, at = np.frombuffer(raw, f"<u{self.id_bytes}"), bounds - bounds[0]
            for k, doc_id in enumerate(self.doc_ids(first, last)):
                yield doc_id, int(bounds[k]), ids[at[k] : at[k + 1]]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, shard_rows: int = 16384) -> DataFrame:
    """Encode whole texts into shard files in ascending doc_id order; returns their manifest.

    Manifest: shard, path, n_docs, n_ids. Null texts are empty documents, null doc_ids come first,
    rows that repeat a doc_id are kept in the order of the input among themselves. Rows are dealt to shards by
    sampled ranges of doc_id and, within a doc_id, of that order, so a shard has about ``shard_rows`` rows however the ids lie.
    """
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("place"))
    shards = max(1, -(-docs.select("doc_id").count() // shard_rows))
    order = (F.col("doc_id").asc_nulls_first(), F.col("place"))
    dealt = docs.repartitionByRange(shards, *order).sortWithinPartitions(*order).drop("place")
    dealt = dealt.withColumn("shard", F.spark_partition_id())

    def write(batches):
        words, end, writer, now = encoder(tokenizer), b"", None, None
        end = np.array([] if end_id is None else [end_id], words.dtype).tobytes()

        def done():
            n_docs, n_ids = writer.close()
            return pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32()), "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

        for batch in batches:
            for doc_id, text, k in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["shard"].to_pylist(), strict=True):
                if k != now:
                    if writer:
                        yield done()
                    now, path = k, f"{folder}/shard-{k:06d}.tok"
                    writer = ShardWriter(path, words.dtype.itemsize)
                writer.add(doc_id, words.encode(text) + end)
        if writer:
            yield done()

    return materialize(dealt.mapInArrow(write, "shard int, path string, n_docs long, n_ids long"), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a manifest.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is the unsigned CRC-32 of the
    document's ids as little-endian unsigned 32-bit integers.
    """
    based = running_total(manifest, "shard", "n_ids", "base").select("path", "base")
    shards = max(1, manifest.count())

    def read(batches):
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                rows = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                for doc_id, start, ids in ShardReader(path).documents():
                    rows["doc_id"].append(doc_id)
                    rows["start"].append(base + start)
                    rows["n_tokens"].append(len(ids))
                    rows["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in rows.values()], list(rows))

    dealt = based.repartition(min(shards, 4096))
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int | None = 2, shard_rows: int = 16384) -> DataFrame:
    """Write docs as token files in the shared folder and read them back; see the two functions.

    An empty table gives no file and no row. Other columns are ignored, whatever their names.
    """
    folder = shared_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id, shard_rows))
