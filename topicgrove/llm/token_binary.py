"""Token ids in bit-packed binary files: fixed width, block offsets, random access."""

from __future__ import annotations

import json
import os
import re
import string
import struct
import uuid
import zlib
from array import array
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicgrove.llm.storage import fresh_path, written

MAGIC = b"TGPACK01"
#: bits, ids a block, documents, ids, blocks, where the tables begin
TRAILER = struct.Struct("<IIQQQQ8s")
BLOCK_IDS = 1 << 16
#: words of each half of the cache, and bytes of the longest that is kept: some 50 MB a half with their ids
CACHED_WORDS, LONGEST_KEPT = 200_000, 64
#: the normalizer and the splitter whose words can be taken apart
LOWERED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT_WORDS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
ASCII_MARKS = string.punctuation.encode()
_shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
#: how byte-level models spell a byte: itself where it can be shown, else the next letter from U+0100 on
BYTE_LETTERS = dict(zip([b for b in range(256) if b not in _shown], range(256, 512), strict=False))


def pack(ids: np.ndarray, bits: int) -> bytes:
    """uint32 ids in ``bits`` bits each, little-endian bit order."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = each
    return np.packbits(wide.reshape(-1), bitorder="little").view("<u4")


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with its file system's scheme, as Spark itself would read it, so that executors use the same store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{whole.removeprefix('file:').removeprefix('//')}" if whole.startswith("file:") else whole


class PackedWriter:
    """Documents one after another; ids leave block by block, the tables come last."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.at = 0
        self.doc_ids: list[int | None] = []
        self.starts: list[int] = [0]
        self.offsets: list[int] = [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            self._flush(self.n_held // self.block_ids * self.block_ids)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, "<u4")
        for i in range(0, n, self.block_ids):
            data = pack(ids[i : min(i + self.block_ids, n)], self.bits)
            self.out.write(data)
            self.at += len(data)
            self.offsets.append(self.at)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.n_held)
        tables = (
            np.array([d or 0 for d in self.doc_ids], "<i8"),
            np.array([d is not None for d in self.doc_ids], np.uint8),
            np.array(self.starts, "<u8"),
            np.array(self.offsets, "<u8"),
        )
        for table in tables:
            self.out.write(table.tobytes())
        self.out.write(TRAILER.pack(self.bits, self.block_ids, len(self.doc_ids), self.n_ids, len(self.offsets) - 1, self.at, MAGIC))


class PackedReader:
    """Random access to one file of ``PackedWriter``."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - TRAILER.size)
        self.bits, self.block_ids, docs, self.n_ids, blocks, tables, magic = TRAILER.unpack(source.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        source.seek(tables)
        ids, valid = np.frombuffer(source.read(8 * docs), "<i8"), np.frombuffer(source.read(docs), np.uint8)
        self.doc_ids = [int(d) if v else None for d, v in zip(ids, valid, strict=True)]
        self.starts = np.frombuffer(source.read(8 * (docs + 1)), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(source.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.cached: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def block(self, k: int) -> np.ndarray:
        if self.cached[0] != k:
            self.source.seek(int(self.offsets[k]))
            n = min(self.block_ids, self.n_ids - k * self.block_ids)
            self.cached = k, unpack(self.source.read(int(self.offsets[k + 1] - self.offsets[k])), n, self.bits)
        return self.cached[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        parts, size = [], self.block_ids
        for k in range(start // size, -(-stop // size)):
            parts.append(self.block(k)[max(0, start - k * size) : stop - k * size])
        return np.concatenate(parts) if parts else np.empty(0, "<u4")


class WordEncoder:
    """Ids of whole texts by the tokenizers library, each word of a text encoded once and kept.

    This holds for a file whose normalizer and splitter are LOWERED and SPLIT_WORDS; texts go to the library whole with
    any other. These two never join what ASCII white space parts, so a text's ids are those of
    its words in a row. A text that holds an added token's string goes to the library whole. To the splitter a run of
    letters is one piece and the ASCII marks that end a word another one. Letters below U+0250 are composed already,
    so such a run is lower-cased, spelt by its bytes and given to the library's model; all else to the library whole.
    Words are kept in two halves: when the newer is full it becomes the older, from which words in use come back.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        made = json.loads(self.tokenizer.to_str())
        self.by_words = made["normalizer"] == LOWERED and made["pre_tokenizer"] == SPLIT_WORDS and made["post_processor"] is None
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, run: bytes) -> bytes | None:
        """Ids of a lower-cased run of letters; None if the run is not plain enough for the model alone."""
        if not run.isalpha():  # of bytes: ASCII letters
            text = "" if run.isascii() else run.decode("utf-8", "surrogatepass")
            if not text.isalpha() or max(text) >= "\u0250":
                return None
        found = self.words.get(run) or self.older.get(run)
        if found is None:
            found = array("I", [t.id for t in self.model.tokenize(run.decode("latin-1").translate(BYTE_LETTERS))]).tobytes()
        if len(run) <= LONGEST_KEPT:
            self.words[run] = found
        return found

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Keep the ids of words; those of words too long to be kept are returned."""
        others, kept, long = [], self.words, {}
        for word in words:
            found = self.older.get(word)
            if found is None:
                stem = word.rstrip(ASCII_MARKS)
                run = stem.lower() if stem.isascii() else stem.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass")
                found = self._letters(run) if run else None
                if found is not None and len(stem) < len(word):
                    marks = word[len(stem) :]
                    ids = kept.get(marks)
                    if ids is None:
                        ids = self._library([marks.decode()])[0]
                        if len(marks) <= LONGEST_KEPT:
                            kept[marks] = ids
                    found += ids
            if found is None:
                others.append(word)
            else:
                (kept if len(word) <= LONGEST_KEPT else long)[word] = found
        for i in range(0, len(others), 4096):
            some = others[i : i + 4096]
            for word, ids in zip(some, self._library([w.decode("utf-8", "surrogatepass") for w in some]), strict=True):
                (kept if len(word) <= LONGEST_KEPT else long)[word] = ids
        return long

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian uint32 ids of each text."""
        if not self.by_words:
            for text in texts:
                yield self._library([text or ""])[0]
            return
        for text in texts:
            if len(self.words) > CACHED_WORDS:
                self.words, self.older = {}, self.words
            text = text or ""
            if self.special.search(text):
                yield self._library([text])[0]
                continue
            words = text.encode("utf-8", "surrogatepass").split()
            unknown = set(words).difference(self.words)
            long = self.learn(unknown) if unknown else None
            yield b"".join(map((ChainMap(self.words, long) if long else self.words).__getitem__, words))


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def vocabulary_bits(path: str) -> int:
    return max(1, (_encoder(path).tokenizer.get_vocab_size() - 1).bit_length())


def write_token_files(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, append ``end_id`` to each document and write packed files in ascending id order to ``folder``.

    Gives the manifest (part, path, n_docs, n_ids), a row a file. A task writes under a name of its own and moves
    the file into place when whole; only files of tasks that succeeded are in the manifest, so a lost executor
    leaves unused files at worst. Null ids come first; rows of equal ids are ordered by their text's hash.
    Null and empty texts hold the end id alone. An empty table gives an empty manifest.
    """
    bits, folder = vocabulary_bits(tokenizer_file), qualified(docs.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, end = _encoder(tokenizer_file), None, np.uint32(end_id).tobytes()
        store, place = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name, out = f"{place}/tokens-{part:06d}-{uuid.uuid4().hex}.bin", None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store.create_dir(place, recursive=True)
                out = store.open_output_stream(f"{name}.part")
                writer = PackedWriter(out, bits)
            texts = (t.as_py() for t in batch.column(1))
            for doc_id, data in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                writer.add(doc_id, np.frombuffer(data + end, "<u4"))
        if writer is not None:
            writer.close()
            out.close()
            store.move(f"{name}.part", name)
            row = {"part": [part], "path": [name], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.n_ids]}
            yield pa.RecordBatch.from_pydict(row)

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(rows.mapInArrow(write, "part long, path string, n_docs long, n_ids long"), "manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    A row a document in the files, so null ids, repeated rows and texts without tokens come back as they were written;
    of a very long document the ids are read at once. An empty manifest gives an empty table.
    """
    spark, folder = manifest.sparkSession, qualified(manifest.sparkSession, folder)
    files, before, rows = manifest.orderBy("part").collect(), 0, []  # a row a file
    for f in files:
        rows.append((f["path"], before))
        before += f["n_ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(folder)[0]
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as source:
                    reader = PackedReader(source)
                    starts = reader.starts
                    crcs = [zlib.crc32(reader.ids(a, b).tobytes()) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                    columns = [pa.array(reader.doc_ids, pa.int64()), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_index(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder and read them back; see ``write_token_files``."""
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer_file, end_id, folder, id_col, text_col), folder)
