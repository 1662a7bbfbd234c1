"""Token ids in files of fixed-width bit packing.

Each id takes the minimum bits of its vocabulary, least significant first: 64 ids make as many 64-bit words as an id has
bits, so both ways are a few numpy operations on whole blocks. A file is a header, blocks of ``BLOCK`` ids each (the last
one filled up with zeros), the table of its documents (id, null mark, first id), the offsets of its blocks, and a footer.
Any range of ids, and any document, is read by its blocks alone.

Writing deals documents by ranges of (id, text hash) and sorts them, so files one after the other hold all ids in ascending
order of documents. A task streams its range into one file named for the attempt; the manifest, a small Parquet table
that Spark commits, names the files of attempts that succeeded, so that lost executors leave at most unused files. A task
holds one slice of text, one block and its table of documents.

Defined results: a null or empty text is the end id alone; a null id comes first; documents of one id, alike or not, are
written each, in order of their text's hash; texts of any length are written whole; no rows give no files and no rows;
columns besides id and text, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ready, shared_folder, table
from .text_ids import encoded, tokenizer_file

#: Marks of the format. The header has the mark, bits of an id, ids of a block; the footer has ids,
#: documents, places of the documents' table and of the offsets, and the mark again.
MARK, HEADER, FOOTER = b"QTOKBITS", struct.Struct("<8sII"), struct.Struct("<QQQQ8s")

#: Ids of a block, a multiple of 64.
BLOCK = 8192

MANIFEST = "file string, first_id long, first_hash long, n_docs long, n_ids long, bits long"


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """``ids``, filled up with zeros to a multiple of 64, in ``bits`` bits each."""
    rows = np.zeros((-(-len(ids) // 64), 64), dtype=np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(rows), bits), dtype="<u8")
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        words[:, word] |= rows[:, k] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= rows[:, k] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack_bits(data: bytes, bits: int) -> np.ndarray:
    """The ids of ``pack_bits``, with those filled up, as unsigned 32-bit integers."""
    words = np.frombuffer(data, dtype="<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), dtype="<u4")
    mask = np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        got = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            got = got | words[:, word + 1] << np.uint64(64 - shift)
        out[:, k] = got & mask
    return out.reshape(-1)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Of a path on a file system that all executors see, or of a URI."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class TokenWriter:
    """Streams documents into one file."""

    def __init__(self, path: str, bits: int, block: int = BLOCK) -> None:
        system, name = file_system(path)
        self.out, self.bits, self.block = system.open_output_stream(name), bits, block
        self.out.write(HEADER.pack(MARK, bits, block))
        self.rest, self.n_ids, self.offsets, self.docs = np.empty(0, "<u4"), 0, [HEADER.size], []

    def _blocks(self, ids: np.ndarray) -> None:
        """Whole blocks, or the last one."""
        size = self.block // 64 * self.bits * 8
        data = pack_bits(ids, self.bits)
        self.out.write(data)
        self.offsets += [self.offsets[-1] + min(at + size, len(data)) for at in range(0, len(data), size)]

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> None:
        self.docs.append((doc_ids, nulls, self.n_ids + bounds[:-1]))
        self.n_ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // self.block * self.block
        if whole:
            self._blocks(ids[:whole])
        self.rest = ids[whole:].copy()

    def close(self) -> tuple[int, int]:
        """Documents and ids."""
        if len(self.rest):
            self._blocks(self.rest)
        doc_ids, nulls, starts = (np.concatenate(x) if self.docs else np.empty(0) for x in (zip(*self.docs, strict=True) if self.docs else ((), (), ())))
        at = self.offsets[-1]
        for x, kind in ((doc_ids, "<i8"), (starts, "<u8"), (nulls, "u1")):
            self.out.write(x.astype(kind).tobytes())
        self.out.write(np.array(self.offsets, dtype="<u8").tobytes())
        self.out.write(FOOTER.pack(self.n_ids, len(doc_ids), at, at + 17 * len(doc_ids), MARK))
        self.out.close()
        return len(doc_ids), self.n_ids


class TokenReader:
    """Documents, and any range of ids, of one file."""

    def __init__(self, path: str) -> None:
        system, name = file_system(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        mark, self.bits, self.block = HEADER.unpack(self._at(0, HEADER.size))
        self.n_ids, self.n_docs, docs, offsets, end = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if mark != MARK or end != MARK:
            raise ValueError(f"{path} is not a whole file of token ids")
        n = self.n_docs
        self.doc_ids = np.frombuffer(self._at(docs, 8 * n), "<i8")
        self.starts = np.append(np.frombuffer(self._at(docs + 8 * n, 8 * n), "<u8").astype(np.int64), self.n_ids)
        self.nulls = np.frombuffer(self._at(docs + 16 * n, n), "u1").astype(bool)
        self.offsets = np.frombuffer(self._at(offsets, size - FOOTER.size - offsets), "<u8").astype(np.int64)

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, from their blocks alone."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        data = self._at(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        return unpack_bits(data, self.bits)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's document ``k``."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def checksums(self, blocks: int = 128) -> np.ndarray:
        """The crc32 of each document's ids as little-endian unsigned 32-bit integers, ``blocks`` blocks in memory."""
        out, k, step = np.zeros(self.n_docs, dtype=np.int64), 0, blocks * self.block
        ends = self.starts[1:]
        for at in range(0, self.n_ids, step):
            ids = self.ids(at, at + step)
            data, k0 = memoryview(ids.tobytes()), k
            while k < self.n_docs and ends[k] <= at + len(ids):
                k += 1
            cuts = np.clip(self.starts[k0 : k + 2] - at, 0, len(ids)).tolist()
            for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                out[k0 + j] = zlib.crc32(data[4 * a : 4 * b], int(out[k0 + j]))
        return out


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts, each with the end id, into files of ``folder``, a path or URI that driver and executors share.
    Files hold ranges of documents, as many as shuffles have partitions or, if planned adaptively, fewer. The manifest, a row
    per file."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    ready(spark)
    largest = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True) - 1, end_id)
    bits = largest.bit_length()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            for rows, ids, bounds in encoded(batch, tokenizer_path, end_id):
                doc_ids = rows.column(0)
                if writer is None:
                    name = f"ids-{uuid.uuid4().hex}.bits"
                    writer = TokenWriter(f"{folder}/{name}", bits)
                    first = (doc_ids[0].as_py(), rows.column(1)[0].as_py())
                writer.add(doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False), ids, bounds)
        if writer is not None:
            n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "first_id": first[0], "first_hash": first[1], "n_docs": n_docs, "n_ids": n_ids, "bits": bits}])

    system, name = file_system(folder)
    system.create_dir(name, recursive=True)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    dealt = plain.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash")
    dealt.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    ready(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # a row per file, so one task orders them all
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_hash", "file").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenReader(f"{folder}/{row['file']}")
                columns = [
                    pa.array(file.doc_ids, pa.int64(), mask=file.nulls),
                    pa.array(row["base"] + file.starts[:-1], pa.int64()),
                    pa.array(np.diff(file.starts), pa.int64()),
                    pa.array(file.checksums(), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, manifest.count())
    return placed.repartition(tasks, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as files of token ids and read back."""
    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_file(), 1)
    return read_token_files(spark, folder)
