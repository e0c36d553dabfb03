"""Token ids as binary files: one array of ids a file, document boundaries beside it in Elias-Fano code.

A file holds documents that follow each other in doc_id order:

    magic QMTOKEN1 | width, nulls (uint32) | documents, ids (uint64) | least doc_id (int64) | bytes of the two codes (uint64, uint64)
    boundaries: Elias-Fano code of 0 and the end of each document, documents + 1 numbers
    names: Elias-Fano code of doc_id - least doc_id of the documents that have one; those without come first
    ids: `width` bytes each, little-endian, at the next multiple of 8

An Elias-Fano code keeps the low bits of each number as they are and its high bits as a string of ones
among zeros; number i is found from the place of the i-th one. Places of every SAMPLE-th one are kept in
32 bits, so reading one number costs a short look from there, at two bits and the low ones a document.

Tasks sort documents by ranges of doc_id, encode and write their own files, each under a name that its range
and number give, by a temporary file and a move: a task that runs again writes the same bytes. The
manifest, a Parquet table written by Spark, has a row for each file; starts over all documents are sums over it.

Defined cases: a null text has no id but its end id; a null doc_id comes first; documents of one doc_id come in the
order of their texts' hashes, repeated rows one after the other; an empty table makes no file and an empty result;
extra columns are not read; doc_id must be an integer. A document longer than FILE_IDS has a file of its own.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.word_bpe import FAST_BELOW, LETTER, NUMBER, SPACE
from quillmesh.llm.worker_state import only
from quillmesh.runtime import shared_dir, table

MAGIC = b"QMTOKEN1"
HEADER = struct.Struct("<8sIIQQqQQ")
CODE = struct.Struct("<QIIQ")
SAMPLE = 512
END_ID = 0
#: A file is closed when it has this many ids.
FILE_IDS = 16_000_000

# ---------------------------------------------------------------- Elias-Fano


def encode(values: np.ndarray) -> bytes:
    """The code of numbers that never fall, uint64."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    most = int(values[-1]) if n else 0
    low = max(0, (most // n).bit_length() - 1) if n else 0
    head = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    ones = np.zeros((int(head[-1]) + 1 if n else 0) + 7 >> 3 << 3, np.uint8)
    ones[head] = 1
    high = np.packbits(ones, bitorder="little").tobytes()
    bits = (values[:, None] >> np.arange(low, dtype=np.uint64)[None, :]).astype(np.uint8) & 1 if low else np.zeros((0, 0), np.uint8)
    samples = head[::SAMPLE].astype("<u4").tobytes()
    return CODE.pack(n, low, len(samples) // 4, len(high)) + samples + high + np.packbits(bits.ravel(), bitorder="little").tobytes()


class EliasFano:
    """Reads a code where it lies: one number at a time or all of them."""

    def __init__(self, data, at: int = 0):
        self.n, self.low, samples, high = CODE.unpack_from(data, at)
        at += CODE.size
        self.samples = np.frombuffer(data, "<u4", samples, at)
        self.high = np.frombuffer(data, np.uint8, high, at + 4 * samples)
        self.bits = np.frombuffer(data, np.uint8, (self.n * self.low + 7) // 8, at + 4 * samples + high)

    def select(self, i: int) -> int:
        """The place of the i-th one, from 0."""
        place = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, place >> 3
        skip = place & 7
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 128], bitorder="little")[skip:])
            if left < len(ones):
                return 8 * byte + skip + int(ones[left])
            left, byte, skip = left - len(ones), byte + 128, 0

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        first = i * self.low
        own = np.unpackbits(self.bits[first >> 3 : (first + self.low + 7) >> 3], bitorder="little")[first & 7 :][: self.low]
        return (self.select(i) - i) << self.low | sum(int(b) << k for k, b in enumerate(own))

    def values(self) -> np.ndarray:
        head = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        out = head.astype(np.uint64) << np.uint64(self.low)
        if self.low:
            bits = np.unpackbits(self.bits, bitorder="little", count=self.n * self.low).reshape(self.n, self.low)
            for k in range(self.low):
                out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out


# ---------------------------------------------------------------- files


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> list[bytes]:
    """The parts of a file of documents in order, those without an id first."""
    names = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(names[0]) if len(names) else 0
    bounds = encode(np.r_[0, np.cumsum(lengths)])
    code = encode(names.view(np.uint64) - np.int64(least).view(np.uint64))  # differences modulo 2**64
    head = HEADER.pack(MAGIC, width, len(doc_ids) - len(names), len(doc_ids), len(ids) // width, least, len(bounds), len(code))
    return [head, bounds, code, bytes(-(HEADER.size + len(bounds) + len(code)) % 8), ids]


class TokenFile:
    """A file's documents: their ids and doc_ids by number, without reading the others."""

    def __init__(self, data):
        magic, self.width, self.nulls, self.documents, n, self.least, bounds, names = HEADER.unpack_from(data, 0)
        at = HEADER.size + bounds + names
        at += -at % 8
        if magic != MAGIC or len(data) != at + n * self.width:
            raise ValueError("not a whole token file")
        self.bounds, self.names = EliasFano(data, HEADER.size), EliasFano(data, HEADER.size + bounds)
        self.ids = np.frombuffer(data, f"<u{self.width}", n, at)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds[i] : self.bounds[i + 1]]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.names[i - self.nulls]

    def at(self, position: int) -> int:
        """The document that holds the id at a position."""
        if not 0 <= position < len(self.ids):
            raise IndexError(position)
        low, high = 0, self.documents
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.bounds[middle] <= position else (low, middle)
        return low

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.names.values() + np.int64(self.least).view(np.uint64)).view(np.int64).tolist()


# ---------------------------------------------------------------- ids of texts


class ByteIds:
    """texts -> bytes of their ids by a byte-level BPE tokenizer file; each different word is encoded once while the dictionary has room.

    No merge crosses a word of the tokenizer's own pattern. It is spelled out for characters below U+0180; texts with
    others, or with a special token's string, go through the tokenizer whole. Words without ids are encoded
    together, a line each: the line feed is a word of its own wherever it stands between two of them.
    """

    def __init__(self, path: str, limit: int = 650_000, chunk_chars: int = 4_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.chunk_chars = limit, chunk_chars
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        specials = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.slow = re.compile("|".join([f"[^\\x00-\\u{FAST_BELOW - 1:04x}]", *specials]))
        space = re.escape(SPACE)
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{space}{LETTER}{NUMBER}]+|[{space}]+(?![^{space}])|[{space}]+")
        self.blank = re.compile(f"[{space}]+")
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def together(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode("\n".join(words), add_special_tokens=False).ids, self.kind)
        cuts = np.flatnonzero(ids == self.line)
        if len(cuts) != len(words) - 1:
            return [self.whole(w) for w in words]
        joined = ids.tobytes()
        return [joined[a:b] for a, b in zip((self.width * np.r_[0, cuts + 1]).tolist(), (self.width * np.r_[cuts, len(ids)]).tolist(), strict=True)]

    def chunk(self, texts: list[str]) -> list[bytes]:
        cut = [None if self.slow.search(t) else self.words.findall(t) for t in texts]
        cache = self.cache
        missing = [w for w in set().union(*(c for c in cut if c)) if w not in cache]
        plain = [w for w in missing if not self.blank.fullmatch(w)]
        for w in set(missing).difference(plain):
            cache[w] = self.whole(w)
        if plain:
            cache.update(zip(plain, self.together(plain), strict=True))
        out = [self.whole(t) if c is None else b"".join(map(cache.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]
        if len(cache) > self.limit:
            for w in missing:
                del cache[w]
        return out

    def many(self, texts: list[str]) -> Iterator[bytes]:
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= self.chunk_chars:
                yield from self.chunk(held)
                held, size = [], 0
        yield from self.chunk(held)


def byte_ids(path: str) -> ByteIds:
    """One per Python worker."""
    return only(("byte_ids", path), lambda: ByteIds(path))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- DataFrames


def put(store: fs.FileSystem, path: str, parts: list[bytes]) -> None:
    """A file that is there whole or not at all."""
    half = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(half) as out:
        for part in parts:
            out.write(part)
    store.move(half, path)


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, file_ids: int = FILE_IDS) -> None:
    """Write the ids of docs (doc_id, text), an end id after each, to `folder`: a URI that driver and executors share. files/*.ids and manifest."""
    path = path or vocabulary_path()

    def write(batches):
        store, root = fs.FileSystem.from_uri(f"{folder}/files")
        store.create_dir(root, recursive=True)
        encoder, part, number = byte_ids(path), TaskContext.get().partitionId(), 0
        end = END_ID.to_bytes(encoder.width, "little")
        doc_ids, lengths, parts, size = [], [], [], 0

        def close():
            name = f"{part:08d}-{number:06d}.ids"
            ids = b"".join(parts)
            put(store, f"{root}/{name}", file_bytes(doc_ids, lengths, ids, encoder.width))
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "documents": len(doc_ids), "ids": size}], MANIFEST)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.many([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                doc_ids.append(doc_id)
                parts += (ids, end)
                lengths.append(len(ids) // encoder.width + 1)
                size += lengths[-1]
                if size >= file_ids:
                    yield close()
                    number += 1
                    doc_ids, lengths, parts, size = [], [], [], 0
        if doc_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_h", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    order = ["doc_id", "_h", "_row"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    placed.mapInArrow(write, "part int, number int, documents long, ids long").write.parquet(f"{folder}/manifest")


MANIFEST = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64())])


def file_starts(spark: SparkSession, folder: str) -> DataFrame:
    """part, number and the ids of all files before: a row a file."""
    files = spark.read.schema("part int, number int, documents long, ids long").parquet(f"{folder}/manifest")
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", before(Window.orderBy("part")).alias("_before"))  # a row a range of doc_ids
    return files.withColumn("_own", before(Window.partitionBy("part").orderBy("number"))).join(parts, "part").select("part", "number", (F.col("_before") + F.col("_own")).alias("file_start"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                own = TokenFile(content.as_buffer())
                part, number = (int(x) for x in re.search(r"(\d+)-(\d+)\.ids$", name.as_py()).groups())
                bounds = own.bounds.values().astype(np.int64)
                wide = memoryview(own.ids.astype("<u4").tobytes())
                places = (4 * bounds).tolist()
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(places, places[1:], strict=False)]
                n = own.documents
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, number), pa.int32()), pa.array(own.doc_ids(), pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    names=["part", "number", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    starts = file_starts(spark, folder)
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.ids")
    if not starts.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = files.load(f"{folder}/files").select("path", "content").mapInArrow(read, "part int, number int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "number"]).select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents", "doc_id", "text"), folder)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return read_token_files(spark, folder)
