"""Token ids in files of independent zstandard frames with a trailing seek table.

One file holds one shard. Its frames each hold the ids of some whole documents (unsigned 16-bit little-endian where the
vocabulary allows, else 32-bit). A skippable frame with the shard's index follows (document ids, token counts, frame
numbers, which ids are null), then the seek table of the public seekable zstandard format: for each frame its compressed and decompressed
size and the lower half of the XXH64 of its content. A reader takes the footer, the table and the index, and then
decompresses only the frames of the documents that it wants.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxaspark.llm.common import new_path, stored, text_or_empty
from taxaspark.llm.encoding import batches_of, encoder

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEK_FRAME_MAGIC, SEEK_FOOTER_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_TOKENS = 65_536
MANIFEST = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64())])


class ShardWriter:
    """Writes one shard to a temporary name; ``close`` moves it to its place, so that a retried task leaves no half file."""

    def __init__(self, uri: str, attempt: str, width: int = 2, level: int = 3):
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temp = f"{self.path}.{attempt}"
        self.out = self.fs.open_output_stream(self.temp)
        self.dtype, self.pack = np.dtype(f"<u{width}"), zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.width, self.table, self.pending, self.held = width, [], [], 0
        self.doc_ids, self.counts, self.frames = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: unsigned 32-bit; an error if one doesn't fit the shard's width."""
        wide = np.frombuffer(ids, dtype="<u4")
        a = wide.astype(self.dtype)
        if self.width < 4 and len(wide) and int(wide.max()) >> 8 * self.width:
            raise ValueError(f"token id {wide.max()} needs more than {self.width} bytes")
        self.doc_ids.append(doc_id)
        self.counts.append(len(a))
        self.frames.append(len(self.table))
        self.pending.append(a)
        self.held += len(a)
        if self.held >= FRAME_TOKENS:
            self._flush()

    def _flush(self) -> None:
        if self.pending:
            raw = np.concatenate(self.pending).tobytes()
            self.out.write(z := self.pack.compress(raw))
            self.table.append((len(z), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.pending, self.held = [], 0

    def close(self) -> None:
        self._flush()
        none = np.array([d is None for d in self.doc_ids], bool)
        ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        index = struct.pack("<BQ", self.width, len(ids)) + ids.tobytes() + np.array(self.counts, "<u4").tobytes() + np.array(self.frames, "<u4").tobytes() + np.packbits(none).tobytes()
        z = self.pack.compress(index)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(z)) + z)
        self.table.append((len(z) + 8, 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF))
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        self.out.write(struct.pack("<II", SEEK_FRAME_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEK_FOOTER_MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.path)


class ShardReader:
    """Random access to a shard."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_FOOTER_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError(f"{uri} doesn't end in a seek table")
        self.table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        index = self._checked(zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[n - 1]) + 8, int(self.table[n - 1, 0]) - 8)), n - 1)
        width, docs = struct.unpack("<BQ", index[:9])
        self.dtype = np.dtype(f"<u{width}")
        none = np.unpackbits(np.frombuffer(index, np.uint8, -1, 9 + 16 * docs), count=docs).astype(bool)
        self.doc_ids = [None if x else d for x, d in zip(none.tolist(), np.frombuffer(index, "<i8", docs, 9).tolist())]
        self.counts = np.frombuffer(index, "<u4", docs, 9 + 8 * docs)
        self.frames = np.frombuffer(index, "<u4", docs, 9 + 12 * docs)

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def _checked(self, raw: bytes, k: int) -> bytes:
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} fails its checksum")
        return raw

    def frame(self, k: int) -> np.ndarray:
        """The ids of frame ``k``, as unsigned 32-bit."""
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(self.table[k, 0])))
        return np.frombuffer(self._checked(raw, k), self.dtype).astype("<u4")

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
        """(place in the shard, document id, ids); with ``wanted`` only those documents, and only their frames are read."""
        last, ids, at = -1, np.zeros(0, "<u4"), 0
        for i, (d, n, k) in enumerate(zip(self.doc_ids, self.counts.tolist(), self.frames.tolist())):
            if k != last:
                last, at, ids = k, 0, None
            if wanted is None or d in wanted:
                ids = self.frame(k) if ids is None else ids
                yield i, d, ids[at : at + n]
            at += n


def _write(batches, tokenizer: str, end_id: int, uri: str, width: int, space_joins: bool):
    words, writer, tokens, docs = encoder(tokenizer, space_joins), None, 0, 0
    shard = TaskContext.get().partitionId()
    path, end = f"{uri}/shard-{shard:08d}.zst", np.array([end_id], "<u4").tobytes()
    for batch in batches:
        texts, doc_ids = batch["text"].to_pylist(), batch["doc_id"].to_pylist()
        for a, b in batches_of(texts):
            for d, ids in zip(doc_ids[a:b], words.encode(texts[a:b])):
                writer = writer or ShardWriter(path, str(TaskContext.get().taskAttemptId()), width)
                writer.add(d, ids + end)
                tokens, docs = tokens + len(ids) // 4 + 1, docs + 1
    if writer:
        low, high = writer.doc_ids[0], writer.doc_ids[-1]
        writer.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "docs": [docs], "tokens": [tokens], "first_doc": [low], "last_doc": [high]}, schema=MANIFEST)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, uri: str | None = None, shards: int | None = None, width: int = 2, space_joins: bool = True) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write shards in ascending doc_id order; returns the manifest, one row a shard.

    Manifest: shard, path, docs, tokens, first_doc, last_doc, and ``start``, the ids in the shards before. A null text
    is empty; every document gets ``end_id``. Null document ids come first and stay null; repeated ids are kept, ordered
    by text, and equal rows are alike. A text of any length lies in one frame. An empty table gives an empty manifest;
    other columns aren't read. ``width``: bytes of an id, an error where one doesn't fit. Shards follow the input's own splits in number; rows are
    dealt by ranges of (doc_id, hash of text), so that no id can swamp a task.
    """
    uri = uri or new_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n = shards or max(1, docs.rdd.getNumPartitions())
    dealt = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    schema = "shard long, path string, docs long, tokens long, first_doc long, last_doc long"
    write = partial(_write, tokenizer=tokenizer, end_id=end_id, uri=uri, width=width, space_joins=space_joins)
    manifest = stored(dealt.mapInArrow(write, schema), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            reader, out, start = ShardReader(row["path"]), [], row["start"]
            for _, d, ids in reader.documents():
                out.append((d, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes() if row["ids"] else None))
                start += len(ids)
                if len(out) >= 2000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    a, b, c, d, e = map(list, zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(e, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def read_tokens(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """Per document of the shards: doc_id, start, n_tokens, ids_crc32, ids (little-endian unsigned 32-bit, or null)."""
    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4)
    rows = manifest.select("path", "start", F.lit(ids).alias("ids"), "shard").repartition(n, "shard").drop("shard")
    return rows.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _fetch(batches):
    for batch in batches:
        for row in batch.to_pylist():
            out = [(d, 0, len(x), zlib.crc32(x.tobytes()), x.tobytes()) for _, d, x in ShardReader(row["path"]).documents(set(row["wanted"]))]
            if out:
                yield _rows(out).select(["doc_id", "n_tokens", "ids"])


def fetch_tokens(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids of the documents in ``wanted`` (doc_id): each shard is opened at its table and only the
    frames of wanted documents are decompressed."""
    want = wanted.select(F.col("doc_id").alias("w")).distinct()
    pairs = manifest.join(want, F.col("w").between(F.coalesce("first_doc", F.lit(-(1 << 63))), F.coalesce("last_doc", F.lit(-(1 << 63))))).withColumn("slice", F.pmod(F.xxhash64("w"), F.ceil(F.col("docs") / 50_000)))
    return pairs.groupBy("path", "slice").agg(F.collect_list("w").alias("wanted")).select("path", "wanted").mapInArrow(_fetch, "doc_id long, n_tokens long, ids binary")
