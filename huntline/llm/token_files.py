"""Token ids as length-delimited binary records with an index for shuffled reads.

A data file is a header (magic, version, bytes per id) and one frame per
document:

    length of the payload   uint64
    masked CRC of the above uint32
    payload                 1 byte: 1 if the key is null; key, int64; ids
    masked CRC of payload   uint32

all little-endian. The mask is the rotation by 15 bits plus a constant that
keeps a checksum of data that holds checksums apart; the CRC is the common
CRC-32. Beside it lies an index file of uint64 frame offsets, so that a reader
can visit frames in any order without scanning.

Documents are range-partitioned by key, so files follow each other in key
order. Each task writes files of its own name and reports them; the manifest,
a Parquet table, lists the files of the attempts that were committed, so a task
that runs again leaves no double records. Files are opened through pyarrow's
file systems, so the folder can be any URI those know.

Defined results: a null or empty text is the end id alone; a null key comes
first; repeated rows are records of their own, in no defined order among
themselves; an empty table gives an empty manifest; extra columns are not read.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import saved, shared_folder
from .text import pieces

MAGIC = b"HLTK"
HEADER = struct.Struct("<4sHH")
LENGTH, CRC, KEY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<?q")
FILE_BYTES = 32 << 20
CACHED_WORDS = 500_000
#: Texts are encoded in pieces of about so many bytes, so that frequent words are looked up once for many texts.
PIECE_BYTES = 2 << 20
MANIFEST = "part int, file string, index string, records long, ids long, width int"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class TextEncoder:
    """Encodes whole texts to packed little-endian ids, with any tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Packed ids of each text of an array of strings without nulls."""
        for ids in self.ids(texts.to_pylist()):
            yield self.pack(ids)


#: What a tokenizer must say of itself for its words to be encoded one by one (fixed values of the file format).
APART_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
APART_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
APART_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def words_apart(path: str) -> bool:
    """Whether the ids of a text are those of its words: from the tokenizer's own description, never by name."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    steps = (told.get("normalizer") or {}).get("normalizers"), (told.get("pre_tokenizer") or {}).get("pretokenizers")
    model = told.get("model") or {}
    plain_tokens = all(not t["content"].strip() or t["content"].startswith("<|") for t in told.get("added_tokens") or [])
    return steps == (APART_NORMALIZERS, [APART_SPLIT, APART_BYTES]) and model.get("type") == "BPE" and not model.get("dropout") and plain_tokens


class WordEncoder(TextEncoder):
    """Encodes texts word by word, remembering the packed ids of recent words.

    For tokenizers that lower-case, drop white space, split letters from
    punctuation and never merge across these (`words_apart`): the ids of a text
    are then those of its words, one after the other. Two generations of the
    memory bound it and keep frequent words.

    Words not in memory: lower-case Latin letters with a tail of punctuation go
    straight to the tokenizer's model, letters and tail each by itself; all
    others go through the whole tokenizer, a few dozen in one text, kept apart
    by a control character that is a token of its own.
    """

    #: ASCII and Latin-1 letters that are lower case, then punctuation but the apostrophe, which may begin a suffix.
    PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
    APART = "\x01"
    TOGETHER = 50

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        super().__init__(path)
        self.cached, self.new, self.old, self.parts = cached, {}, {}, {}
        (self.apart,) = self.ids([self.APART])[0]
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = {c: spell(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}
        self.code = "H" if self.width == 2 else "I"
        self.tokenize = self.tokenizer.model.tokenize

    def _learn(self, words: list[bytes]) -> None:
        if len(self.new) > self.cached:
            self.old, self.new = self.new, {}
        if len(self.parts) > self.cached:
            self.parts = {}
        new, old, parts, plain, others = self.new, self.old, self.parts, self.PLAIN.fullmatch, []
        tokenize, letters, code = self.tokenize, self.letters, self.code
        new.setdefault(b"", b"")  # before and after white space at the ends of a text
        for w in words:
            if w in new:
                continue
            ids = old.get(w)
            if ids is None:
                m = plain(w)
                if m is None or b"<|" in w:
                    others.append(w)
                    continue
                head, tail = m.groups()
                ids = parts.get(head)
                if ids is None:
                    spelt = head.decode() if head.isascii() else head.decode().translate(letters)
                    ids = parts[head] = array(code, [t.id for t in tokenize(spelt)]).tobytes()
                if tail:
                    end = parts.get(tail)
                    if end is None:
                        end = parts[tail] = self.pack(self.ids([tail.decode()])[0])
                    ids += end
            new[w] = ids
        # A special token or the control character inside a word: by itself.
        alone = [w for w in others if b"<|" in w or b"\x01" in w]
        for w, ids in zip(alone, self.ids([w.decode() for w in alone]), strict=True):
            new[w] = self.pack(ids)
        rest = [w for w in others if w not in new]
        lots = [rest[i : i + self.TOGETHER] for i in range(0, len(rest), self.TOGETHER)]
        for lot, ids in zip(lots, self.ids([f" {self.APART} ".join(w.decode() for w in lot) for lot in lots]), strict=True):
            packed = np.array(ids, self.dtype)
            for w, part in zip(lot, np.split(packed, np.flatnonzero(packed == self.apart)), strict=True):
                new[w] = (part if w is lot[0] else part[1:]).tobytes()

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        # The tokenizer lower-cases anyway; special tokens are matched before it does.
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().cast(pa.binary()).dictionary_encode()
        words, at = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        self._learn(words)
        packed = list(map(self.new.__getitem__, words))
        # The ids of all different words in one array, gathered in the order of the texts.
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.width
        pool, begins = np.frombuffer(b"".join(packed), self.dtype), np.cumsum(sizes) - sizes
        counts = sizes[at]
        ends = np.cumsum(counts)
        ids = pool[np.repeat(begins[at] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *np.asarray(split.value_lengths())])].tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield ids[a:b].tobytes()


@lru_cache(maxsize=1)
def encoder(path: str, word_level: bool | None) -> TextEncoder:
    """One encoder per Python worker, so that tasks share its memory."""
    return WordEncoder(path) if (words_apart(path) if word_level is None else word_level) else TextEncoder(path)


def frame(key: int | None, ids: bytes) -> bytes:
    payload = KEY.pack(key is None, key or 0) + ids
    length = LENGTH.pack(len(payload))
    return b"".join((length, CRC.pack(masked_crc(length)), payload, CRC.pack(masked_crc(payload))))


def _write_part(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, word_level: bool | None) -> Iterator[pa.RecordBatch]:
    tool = encoder(tokenizer, word_level)
    width, end, offsets, total, at = tool.width, tool.pack([end_id]), [], 0, HEADER.size
    store, root = open_folder(folder)
    store.create_dir(root, recursive=True)
    name = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
    out = None
    for batch in pieces(batches, "text", PIECE_BYTES):
        if out is None:
            out = store.open_output_stream(posixpath.join(root, f"{name}.rec"))
            out.write(HEADER.pack(MAGIC, 1, width))
        frames = []
        for k, ids in zip(batch.column("key").to_pylist(), tool.encode(pc.fill_null(batch.column("text"), "")), strict=True):
            frames.append(frame(k, ids + end))
            offsets.append(at)
            at += len(frames[-1])
            total += len(ids) // width + 1
        out.write(b"".join(frames))
    if out is None:
        return
    out.close()
    with store.open_output_stream(posixpath.join(root, f"{name}.idx")) as index:
        index.write(np.array(offsets, "<u8").tobytes())
    row = [TaskContext.get().partitionId(), f"{name}.rec", f"{name}.idx", len(offsets), total, width]
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["part", "file", "index", "records", "ids", "width"])



def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text", word_level: bool | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the token files of docs and returns their manifest (one row per file, in key order of ``part``).

    word_level: whether words may be encoded one by one; by default the tokenizer's file decides.
    """
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # The hash splits a key that many rows share.
    ordered = texts.withColumn("h", F.xxhash64("text")).repartitionByRange(max(1, -(-volume // file_bytes)), "key", "h").sortWithinPartitions("key", "h").drop("h")

    return saved(ordered.mapInArrow(lambda batches: _write_part(batches, folder, tokenizer, end_id, word_level), MANIFEST), "manifest").withColumn("folder", F.lit(folder))


def read_frame(file, width: int) -> tuple[int | None, np.ndarray] | None:
    """The next frame of an open file, checked; None at its end."""
    head = file.read(LENGTH.size + CRC.size)
    if not head:
        return None
    if len(head) < LENGTH.size + CRC.size or CRC.unpack_from(head, LENGTH.size)[0] != masked_crc(head[: LENGTH.size]):
        raise ValueError("damaged frame length")
    (size,) = LENGTH.unpack_from(head)
    body = file.read(size + CRC.size)
    if len(body) < size + CRC.size or CRC.unpack_from(body, size)[0] != masked_crc(body[:size]):
        raise ValueError("damaged frame")
    null, key = KEY.unpack_from(body)
    return (None if null else key), np.frombuffer(body, f"<u{width}", (size - KEY.size) // width, KEY.size)


def read_at(folder: str, file: str, index: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record by its number in the file, through the index: what a shuffled reader does."""
    store, root = open_folder(folder)
    with store.open_input_file(posixpath.join(root, index)) as f:
        f.seek(8 * number)
        (at,) = LENGTH.unpack(f.read(8))
    with store.open_input_file(posixpath.join(root, file)) as f:
        _, _, width = HEADER.unpack(f.read(HEADER.size))
        f.seek(at)
        return read_frame(f, width)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["key", "start", "n_tokens", "ids_crc32"])


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, root = open_folder(row["folder"])
            start, rows = row["start"], []
            with store.open_input_stream(posixpath.join(root, row["file"]), buffer_size=1 << 20) as f:
                magic, _, width = HEADER.unpack(f.read(HEADER.size))
                if magic != MAGIC:
                    raise ValueError(f"not a token file: {row['file']}")
                while (record := read_frame(f, width)) is not None:
                    key, ids = record
                    rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)


def read(manifest: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every record, from the files; start counts the ids of all records before."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("folder", "file", "start")

    n = max(1, manifest.count())
    return files.repartition(n, "file").mapInArrow(_read_files, "key long, start long, n_tokens long, ids_crc32 long")
