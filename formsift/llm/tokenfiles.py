"""Token ids in bit-plane files.

A shard file holds, back to back, parts that each end in a zero byte:

    header   "BPS2", u64 shard, u32 ids in a full block, u8 planes a bit (1) or byte (8) wide
    blocks   each plane of up to `block` ids, one after the other, each a zstandard frame
    docs     zstandard of: i64 keys, u8 key present, u32 ids of each document
    index    of each block: u64 offset, u32 ids, u8 planes, then u32 bytes of each plane
    trailer  u64 index offset, u32 index bytes, u64 docs offset, u32 docs bytes, u64 documents, u64 ids, "BPSE"

Within a block, plane p holds bit (or byte) p of every id, so equal high bits
make long runs. The ids of a shard are one stream in key order; a reader gets
any block by the index alone. Null text counts as empty, a null key sorts first
and comes back null, repeated keys stay separate documents (ordered by text), an empty
table gives no files. Only the two columns named are read. Texts of any length are
encoded whole; a block is all that a reader holds of their ids. Ids are the
tokenizers library's; words are encoded once a worker where the tokenizer file
shows that words do not influence each other, else whole texts are."""

from __future__ import annotations

import codecs
import json
import re
import struct
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formsift.llm.bpe import MEMO_BYTES, MEMO_WORDS, WordMemo, ascii_words, byte_letters, normalize, slices
from formsift.llm.common import in_order, order_bounds, prepare, read_files, shared_path, tokenizer_file, write_frames

BLOCK_IDS = 1 << 16
#: Bytes of text that one task takes, about, and ids after which it begins a new file.
TASK_BYTES, FILE_IDS = 12 << 20, 1 << 24
#: Files that one task may write, as bits of the shard number.
SUB_BITS = 18
HEADER, TRAILER = struct.Struct("<4sQIB"), struct.Struct("<QIQIQQ4s")
END = b"\0"


#: Stands before a word that no space comes before, and for a line feed; neither is part of UTF-8.
FIRST, FEED = b"\xff", b"\xfe"
#: Bytes that may be part of white space after or before a line feed.
AFTER = frozenset(b" \t\r\x0b\x0c\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3")
BEFORE = frozenset(b" \t\r\x0b\x0c\x1c\x1d\x1e\x1f\x80\x81\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x9f\xa0\xa8\xa9\xaf")


#: White space after a space: looked for in pairs only where the single byte is there at all.
RUNS = tuple((bytes([b]), b" " + bytes([b])) for b in sorted({*AFTER, *b"\n"} - {*b" \x1c\x1d\x1e\x1f"}))


def space_words(text: str) -> list[bytes]:
    """Cut before each space, which is left out, and around line feeds that no
    white space touches. A run of white space belongs together, so a text in
    which other white space may follow a space stays whole."""
    raw = text.encode("utf-8", "replace")
    if b"  " in raw or any(one in raw and pair in raw for one, pair in RUNS):
        return [FIRST + raw]
    if b"\n" in raw:
        lines = raw.split(b"\n")
        if all(x and x[0] not in AFTER and x[-1] not in BEFORE for x in lines):
            raw = b" \xfe \xff".join(lines)
    return (FIRST + raw).split(b" ")


def whole(text: str) -> list[bytes]:
    return [FIRST + text.encode("utf-8", "replace")]


def spaced(word: bytes) -> bytes:
    """The stretch of text that a word of space_words or whole stands for."""
    if word[:1] == FIRST:
        return word[1:]
    return b"\n" if word == FEED else b" " + word


#: The split that byte-level files name by `use_regex` alone (a fixed pattern of that kind of tokenizer).
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def splitter(path: str):
    """How texts may be cut without a change of ids, as far as the file shows; the
    stretch of text that a cut stands for; what cuts it further into the
    words of the library's model (or nothing, if it must go through all of the
    library's steps); and whether latin_pieces does so for many at once."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
    special = [t["content"] for t in spec["added_tokens"]]
    steps = pre.get("pretokenizers", [])
    if spec["model"]["type"] != "BPE" or not all(s.startswith("<|") and not any(c.isspace() for c in s) for s in special):
        return whole, spaced, lambda word: None, False
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        cut, stretch, pattern, lower, before = space_words, spaced, BYTE_LEVEL_SPLIT, False, "\u0120"
    elif [p["type"] for p in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and [n["type"] for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        cut, stretch, pattern, lower, before = ascii_words, bytes, steps[0]["pattern"]["Regex"], True, ""
    else:
        return whole, spaced, lambda word: None, False
    split, letters = regex.compile(pattern).findall, byte_letters()

    def pieces_of(word: bytes) -> list[str] | None:
        if len(word) > MEMO_BYTES or b"<|" in word:
            return None
        if not lower or word.islower():
            if word.isalpha():
                return [before + word.decode()]
            if word[-1:] in (b",", b".") and word[:-1].isalpha():
                return [before + word[:-1].decode(), word[-1:].decode()]
        text = stretch(word).decode("utf-8")
        pieces = split(normalize(text) if lower else text)
        return [p if p.isascii() and p.isalpha() else "".join(map(letters.__getitem__, p.encode())) for p in pieces]

    return cut, stretch, pieces_of, lower and pattern == LATIN_SPLIT


#: Words that are looked up together, the words of the usual split in lower-case bytes of ASCII
#: and Latin-1 letters (a line feed stands between words), and words that hold nothing else.
TOGETHER = 1000
LATIN_PIECES = re.compile(rb"\n|'(?:s|t|re|ve|m|ll|d)|(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-/:-@\[-`{-~]+")
LATIN_WORD = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
LATIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands between the ids of words; no id's highest byte is 255, so it is found nowhere else.
BETWEEN = b"\xff\xff\xff\xff"


def latin_pieces(words: list[bytes]) -> list[bytes] | None:
    """What LATIN_SPLIT makes of words without white space, normalized, and a line
    feed between two; nothing if some word may be long, special or in other letters.

    Lower case comes from each character by itself, and such letters are composed."""
    joined = b"\n".join(words)
    if b"<|" in joined or max(map(len, words), default=0) > MEMO_BYTES:
        return None
    joined = joined.lower() if joined.isascii() else joined.decode().lower().encode()
    pieces = LATIN_PIECES.findall(joined)
    return pieces if sum(map(len, pieces)) == len(joined) else None


#: Model words kept with their ids in a worker; words kept where texts are sorted beside it.
MEMO_PIECES, SORTING_WORDS = 250_000, 450_000
_LIBRARY: dict[str, WordMemo] = {}


def library_memo(path: str, words: int = MEMO_WORDS, pieces: int = MEMO_PIECES) -> WordMemo:
    """Texts to ids with the tokenizers library, one a worker and file; it keeps
    so many words, and so many of the model's words, as other work leaves memory for."""
    if path not in _LIBRARY:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file(path))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        cut, stretch, pieces_of, latin = splitter(tokenizer_file(path))
        model, known, most, letters = tokenizer.model, {}, {}, "".join(byte_letters())
        latin = latin and tokenizer.get_vocab_size() < 0xFF000000

        def piece(p: str) -> bytes:
            ids = known.get(p)
            if ids is None:
                ids = array("I", [x.id for x in model.tokenize(p)]).tobytes()
                if len(known) < most["pieces"]:
                    known[p] = ids
            return ids

        def together(words: list[bytes]) -> list[bytes] | None:
            pieces = latin_pieces(words)
            if not pieces:
                return None if pieces is None else []
            ids = list(map(known.get, pieces))
            words_known, made = _LIBRARY[path].known, {b"\n": BETWEEN}
            for k, x in enumerate(ids):
                if x is None:
                    p = pieces[k]
                    ids[k] = x = words_known.get(p) or made.get(p)
                    if x is None:
                        ids[k] = made[p] = array("I", [t.id for t in model.tokenize(codecs.charmap_decode(p, "strict", letters)[0])]).tobytes()
            if len(known) < most["pieces"]:
                if len(words_known) <= _LIBRARY[path].limit:  # whole words will be kept there
                    for w in words:
                        made.pop(w, None)
                known.update(made)
            return b"".join(ids).split(BETWEEN)

        def encode(words: list[bytes]) -> list[bytes]:
            out, rest = {}, []
            for i in range(0, len(words) if latin else 0, TOGETHER):
                part = words[i : i + TOGETHER]
                found = together(part)
                if found is None:
                    part = [w for w in part if len(w) <= MEMO_BYTES and b"<|" not in w and LATIN_WORD.fullmatch(w)]
                    found = together(part)
                out.update(zip(part, found, strict=True))
            for w in [w for w in words if w not in out] if latin else words:
                pieces = pieces_of(w)
                if pieces is not None:
                    out[w] = b"".join(map(piece, pieces))
                else:
                    rest.append(w)
            found = tokenizer.encode_batch_fast([stretch(w).decode("utf-8") for w in rest], add_special_tokens=False)
            out.update((w, array("I", x.ids).tobytes()) for w, x in zip(rest, found, strict=True))
            return [out[w] for w in words]

        _LIBRARY[path] = WordMemo(encode, cut, known.clear)
        _LIBRARY[path].most = most
    memo = _LIBRARY[path]
    memo.limit, memo.most["pieces"] = words, pieces
    return memo


def to_planes(ids: np.ndarray, width: int) -> list[bytes]:
    """Planes of ids, lowest first, as many as the largest id needs."""
    top = int(ids.max(initial=0)).bit_length()
    if width == 8:
        raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [raw[:, p].tobytes() for p in range(max(1, -(-top // 8)))]
    return [np.packbits((ids >> p).astype(np.uint8) & 1).tobytes() for p in range(max(1, top))]


def from_planes(planes: list[bytes], n: int, width: int) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for p, raw in enumerate(planes):
        part = np.frombuffer(raw, np.uint8)
        part = part if width == 8 else np.unpackbits(part, count=n)
        ids |= part.astype(np.uint32) << np.uint32(p * width)
    return ids


class ShardWriter:
    """Frames of one shard file, built from documents in order; holds one block."""

    def __init__(self, shard: int, block: int = BLOCK_IDS, width: int = 1):
        self.shard, self.block, self.width = shard, block, width
        self.at, self.index, self.keys, self.counts = 0, [], [], []
        self.pending, self.held, self.n_ids = [], 0, 0
        self.zstd = zstandard.ZstdCompressor(level=1)

    def _frame(self, data: bytes) -> bytes:
        self.at += len(data) + 1
        return data + END

    def start(self) -> Iterator[bytes]:
        yield self._frame(HEADER.pack(b"BPS2", self.shard, self.block, self.width))

    def _flush(self, every: bool) -> Iterator[bytes]:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        cut = 0
        while len(ids) - cut >= self.block or (every and cut < len(ids)):
            part = ids[cut : cut + self.block]
            planes = [self.zstd.compress(p) for p in to_planes(part, self.width)]
            self.index.append((self.at, len(part), [len(p) for p in planes]))
            yield self._frame(b"".join(planes))
            cut += len(part)
        self.pending, self.held = [ids[cut:]], len(ids) - cut

    def add(self, key: int | None, ids: np.ndarray) -> Iterator[bytes]:
        self.keys.append(key)
        self.counts.append(len(ids))
        self.pending.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= self.block:
            yield from self._flush(False)

    def finish(self) -> Iterator[bytes]:
        yield from self._flush(True)
        docs_at = self.at
        there = np.array([k is not None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        docs = self.zstd.compress(keys.tobytes() + there.tobytes() + np.array(self.counts, "<u4").tobytes())
        yield self._frame(docs)
        index_at = self.at
        index = b"".join(struct.pack(f"<QIB{len(p)}I", o, n, len(p), *p) for o, n, p in self.index)
        yield self._frame(index)
        yield self._frame(TRAILER.pack(index_at, len(index), docs_at, len(docs), len(self.keys), sum(self.counts), b"BPSE"))


class ShardReader:
    """Documents and ids of a shard file, one block in memory at a time."""

    def __init__(self, content: bytes):
        self.raw = memoryview(content)
        magic, self.shard, self.block, self.width = HEADER.unpack_from(content)
        index_at, index_len, docs_at, docs_len, self.n_docs, self.n_ids, end = TRAILER.unpack_from(content, len(content) - TRAILER.size - 1)
        if (magic, end) != (b"BPS2", b"BPSE"):
            raise ValueError("not a bit-plane shard")
        self.blocks, at = [], index_at
        while at < index_at + index_len:
            offset, n, planes = struct.unpack_from("<QIB", content, at)
            self.blocks.append((offset, n, struct.unpack_from(f"<{planes}I", content, at + 13)))
            at += 13 + 4 * planes
        raw = zstandard.ZstdDecompressor().decompress(self.raw[docs_at : docs_at + docs_len], max_output_size=13 * self.n_docs + 1)
        keys, there = np.frombuffer(raw, "<i8", self.n_docs), np.frombuffer(raw, np.uint8, self.n_docs, 8 * self.n_docs)
        self.keys = [k if t else None for k, t in zip(keys.tolist(), there.tolist())]
        self.counts = np.frombuffer(raw, "<u4", self.n_docs, 9 * self.n_docs).astype(np.int64)

    def ids(self, k: int) -> np.ndarray:
        at, n, sizes = self.blocks[k]
        unzip, planes = zstandard.ZstdDecompressor(), []
        for size in sizes:
            planes.append(unzip.decompress(self.raw[at : at + size], max_output_size=self.block + 8))
            at += size
        return from_planes(planes, n, self.width)

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """(key, ids before it in this shard, its ids as parts) in order."""
        k, ids, at, before = -1, np.zeros(0, np.uint32), 0, 0
        for key, n in zip(self.keys, self.counts.tolist()):
            parts, left = [], n
            while left:
                if at == len(ids):
                    k, at = k + 1, 0
                    ids = self.ids(k)
                parts.append(ids[at : at + left])
                at += len(parts[-1])
                left -= len(parts[-1])
            yield key, before, parts
            before += n


def write_tokens(df: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = 2, block: int = BLOCK_IDS, width: int = 1, task_bytes: int = TASK_BYTES, file_ids: int = FILE_IDS) -> None:
    """Encode a text column and write its ids, end_id after each text, as shard
    files in ascending key order (ties by text). A file holds whole documents
    and is made in memory, about file_ids ids; tasks may be of any size."""
    prepare(df.sparkSession)
    source = df.select(F.col(key).cast("bigint").alias(key), text)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        memo, out, parts, sub = library_memo(tokenizer, SORTING_WORDS), None, [], 0
        for batch in batches:
            for part in slices(batch):
                first = part.column(2)[0].as_py() << SUB_BITS if part.num_rows else 0
                for k, ids in zip(part.column(0).to_pylist(), memo.texts(part.column(1).to_pylist())):
                    if out is None:
                        out = ShardWriter(first + sub, block, width)
                        parts = list(out.start())
                    parts += out.add(k, np.frombuffer(ids + end, "<u4"))
                    if out.n_ids >= file_ids:
                        yield whole_file(out, parts)
                        out, sub = None, sub + 1
        if out is not None:
            yield whole_file(out, parts)

    def whole_file(out, parts):
        return pa.RecordBatch.from_arrays([pa.array([b"".join([*parts, *out.finish()])], pa.binary())], ["frame"])

    ordered = in_order(source, key, order_bounds(source, key, text, task_bytes), text)
    write_frames(ordered.mapInArrow(run, "frame binary"), path, per_file=1)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Documents of shard files: key, start (ids of all documents before it),
    n_tokens, ids (little-endian 32-bit, null if not asked for), ids_crc32.

    The starts need each shard's total, two numbers a file, which the driver adds up."""
    prepare(spark)
    files = read_files(spark, path)

    def totals(batches):
        for batch in batches:
            for content in batch.column(0):
                if content.as_buffer().size:
                    shard = ShardReader(content.as_buffer().to_pybytes())
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard.shard], pa.int64()), "n": pa.array([shard.n_ids], pa.int64())})

    base, at = {}, 0
    for shard, n in sorted(files.select("content").mapInArrow(totals, "shard bigint, n bigint").collect()):
        base[shard] = at
        at += n

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                if not content.as_buffer().size:
                    continue
                shard, rows = ShardReader(content.as_buffer().to_pybytes()), []
                for key, before, parts in shard.documents():
                    data = b"".join(p.astype("<u4").tobytes() for p in parts)
                    rows.append((key, base[shard.shard] + before, len(data) // 4, data if ids else None, crc32(data)))
                    if len(rows) == 500:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    def pack(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "start", "n_tokens", "ids", "ids_crc32"])

    return files.select("content").mapInArrow(run, "key bigint, start bigint, n_tokens bigint, ids binary, ids_crc32 bigint")


def token_file_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_tokens(docs, tokenizer, path)
    return read_tokens(spark, path, ids=False).selectExpr("key AS doc_id", "start", "n_tokens", "ids_crc32")
