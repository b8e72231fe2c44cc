"""Token-id files: independent zstandard frames with a trailing seek table.

File layout (little-endian): the documents' frames one after another, then a
skippable frame with the document index, then a skippable frame with the seek
table of the public seekable format (compressed size, decompressed size and
the low half of XXH64 of the content per frame; a footer with the number of
frames). A document's ids fill one frame, or several of ``FRAME_IDS`` ids, so
a reader fetches and decompresses the frames of the documents it asks for and
no others. Ids take two bytes if the vocabulary allows it, else four.

Writing: tasks tokenize and compress where the text is read; only compressed
frames are shuffled, by literal ranges of the id, sorted, and written to new
files of at most ``FILE_BYTES``. A manifest table names the files that count,
so files of failed attempts are never read.

Defined cases: a null or empty text has the end id alone. Null ids sort
first; rows of equal ids follow each other by checksum. An empty table gives
an empty manifest and no file. Columns besides id and text are not read.
Files go to the shared folder through pyarrow's file systems (local and
network mounts, object stores, HDFS with libhdfs).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import tokens
from llm.common import (batches, crc32, documents, id_and_text, offsets, partitions,
                        range_bucket, stage, texts)
from turnlens.session import scratch_dir

FRAME_IDS = 1 << 20
FILE_BYTES = 128 << 20
INDEX_MAGIC = 0x184D2A50
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
#: Document index: id, whether there is one, first frame, ids before in file.
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("frame", "<u4"), ("frames", "<u4")])
SEEK = np.dtype([("compressed", "<u4"), ("content", "<u4"), ("checksum", "<u4")])
HEAD = struct.Struct("<II")
FOOTER = struct.Struct("<IBI")
WIDTH = struct.Struct("<B")


def id_width(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


class FrameWriter:
    """Frames of one file; ``finish`` adds the index and the seek table."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.index: list[tuple] = []
        self.seek: list[tuple] = []
        self.bytes = 0

    def add(self, doc_id: int | None, frames: Iterable[tuple[bytes, int, int]]) -> None:
        """``frames``: compressed bytes, content size, checksum."""
        first = len(self.seek)
        for data, content, checksum in frames:
            self.out.write(data)
            self.bytes += len(data)
            self.seek.append((len(data), content, checksum))
        self.index.append((doc_id or 0, doc_id is not None, first, len(self.seek) - first))

    def finish(self) -> None:
        index = WIDTH.pack(self.width) + np.array(self.index, INDEX).tobytes()
        seek = np.array(self.seek, SEEK).tobytes() + FOOTER.pack(len(self.seek), 0x80, FOOTER_MAGIC)
        self.out.write(HEAD.pack(INDEX_MAGIC, len(index)) + index)
        self.out.write(HEAD.pack(SEEK_MAGIC, len(seek)) + seek)


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, _, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != FOOTER_MAGIC:
            raise ValueError("no seek table at the end of the file")
        at = size - FOOTER.size - n * SEEK.itemsize
        self.seek = np.frombuffer(self._read(at, n * SEEK.itemsize), SEEK)
        self.at = np.concatenate(([0], np.cumsum(self.seek["compressed"], dtype=np.int64)))
        end = int(self.at[-1])
        magic, length = HEAD.unpack(self._read(end, HEAD.size))
        index = self._read(end + HEAD.size, length)
        if magic != INDEX_MAGIC or at - HEAD.size != end + HEAD.size + length:
            raise ValueError("the document index does not fit the seek table")
        self.width = WIDTH.unpack(index[:1])[0]
        self.index = np.frombuffer(index[1:], INDEX)
        self.unpack = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def document(self, row: int) -> np.ndarray:
        """Ids of the document in place ``row``, as unsigned 32-bit."""
        entry = self.index[row]
        first, last = int(entry["frame"]), int(entry["frame"]) + int(entry["frames"])
        data = self._read(int(self.at[first]), int(self.at[last] - self.at[first]))
        parts = []
        for f in range(first, last):
            a = int(self.at[f] - self.at[first])
            raw = self.unpack.decompress(data[a:a + int(self.seek["compressed"][f])],
                                         max_output_size=int(self.seek["content"][f]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.seek["checksum"][f]):
                raise ValueError(f"frame {f} does not match its checksum")
            parts.append(np.frombuffer(raw, f"<u{self.width}").astype("<u4"))
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def find(self, doc_ids: Iterable[int]) -> list[int]:
        """Places of the documents with these ids (rows are in id order)."""
        ids, nulls = self.index["doc_id"], int((self.index["has_id"] == 0).sum())
        found: list[int] = []
        for i in doc_ids:
            a, b = np.searchsorted(ids[nulls:], [i, i + 1])
            found += range(nulls + int(a), nulls + int(b))
        return found

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for row, entry in enumerate(self.index):
            yield (int(entry["doc_id"]) if entry["has_id"] else None), self.document(row)


FRAMES = "doc_id long, ids_crc32 long, n_tokens long, " \
         "frames array<struct<data: binary, content: long, checksum: long>>"


def _to_frames(path: str, vocabulary: int):
    schema = pa.schema([("doc_id", pa.int64()), ("ids_crc32", pa.int64()), ("n_tokens", pa.int64()),
                        ("frames", pa.list_(pa.struct([("data", pa.binary()), ("content", pa.int64()),
                                                       ("checksum", pa.int64())])))])
    width = id_width(vocabulary)

    def rows(found: Iterator[pa.RecordBatch]):
        encode = tokens.Encoder(path)
        pack = zstandard.ZstdCompressor(level=1, write_checksum=True)
        for batch in found:
            doc_ids = batch.column(0).to_pylist()
            for doc_id, ids in zip(doc_ids, encode(texts(batch.column(1))), strict=True):
                raw = np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()
                step = FRAME_IDS * width
                frames = [{"data": pack.compress(raw[a:a + step]), "content": len(raw[a:a + step]),
                           "checksum": xxhash.xxh64_intdigest(raw[a:a + step]) & 0xFFFFFFFF}
                          for a in range(0, len(raw), step)]
                yield doc_id, crc32(ids), len(ids) // 4, frames

    def run(found: Iterator[pa.RecordBatch]):
        yield from batches(rows(found), schema, 4000, 8 << 20,
                           lambda r: sum(len(f["data"]) for f in r[3]))

    return run


def _to_files(folder: str, width: int):
    schema = pa.schema([("bucket", pa.int64()), ("seq", pa.int64()), ("path", pa.string()),
                        ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(found: Iterator[pa.RecordBatch]):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        writer = None
        bucket = seq = n_ids = 0
        done: list[tuple] = []

        def close():
            writer.finish()
            writer.out.close()
            done.append((bucket, seq, path, len(writer.index), n_ids))

        for batch in found:
            for b, doc_id, n, frames in zip(*(batch.column(c).to_pylist() for c in range(4)),
                                            strict=True):
                if writer and (b != bucket or writer.bytes >= FILE_BYTES):
                    close()
                    seq, writer = (seq + 1 if b == bucket else 0), None
                if writer is None:
                    bucket, n_ids = b, 0
                    path = f"{root}/{b:07d}-{seq:05d}-{uuid.uuid4().hex}.zids"
                    writer = FrameWriter(fs.open_output_stream(path), width)
                writer.add(doc_id, ((f["data"], f["content"], f["checksum"]) for f in frames))
                n_ids += n
        if writer:
            close()
        if done:
            yield from batches(done, schema)

    return run


def write(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Write the ids of all documents in id order below ``folder`` and return
    the manifest (bucket, seq, path, n_docs, n_ids, n_ids_before, docs_before)."""
    from tokenizers import Tokenizer

    path = path or tokens.tokenizer_path()
    vocabulary = Tokenizer.from_file(path).get_vocab_size()
    d = docs.select(*id_and_text(docs))
    n = partitions(docs.sparkSession)
    bucket, n = range_bucket(d, "doc_id", n)
    frames = d.mapInArrow(_to_frames(path, vocabulary), FRAMES)
    placed = (frames.withColumn("bucket", bucket).repartitionById(n, "bucket")
              .sortWithinPartitions("bucket", "doc_id", "ids_crc32", "n_tokens"))
    manifest = placed.select("bucket", "doc_id", "n_tokens", "frames").mapInArrow(
        _to_files(folder, id_width(vocabulary)),
        "bucket long, seq long, path string, n_docs long, n_ids long")
    return offsets(stage(manifest, "manifest"), ["bucket", "seq"], ["n_docs", "n_ids"], n)


def _from_files(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def rows(found: Iterator[pa.RecordBatch]):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in found:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(path) as source:
                    for doc_id, ids in FrameReader(source):
                        yield doc_id, at, len(ids), crc32(ids.tobytes())
                        at += len(ids)

    return lambda found: batches(rows(found), schema)


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document, read back from the files: its id, the ids before
    it, its number of ids and their crc32."""
    n = partitions(manifest.sparkSession)
    return manifest.select("path", "n_ids_before").repartition(n).mapInArrow(
        _from_files(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, folder: str, doc_ids: list[int]) -> dict[int, list[np.ndarray]]:
    """Ids of a few requested documents, decompressing only their frames."""
    fs, _ = pafs.FileSystem.from_uri(folder)
    out: dict[int, list[np.ndarray]] = {i: [] for i in doc_ids}
    for row in manifest.orderBy("bucket", "seq").toLocalIterator():
        with fs.open_input_file(row.path) as source:
            reader = FrameReader(source)
            for at in reader.find(doc_ids):
                out[int(reader.index["doc_id"][at])].append(reader.document(at))
    return out


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "token-files")
    return read_digests(write(documents(spark, sf_dir), folder), folder)
