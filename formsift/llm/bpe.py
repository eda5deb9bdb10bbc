"""BPE encoding by batched numpy merge rounds, and the matching decoding.

The symbols of many words lie in one flat array. Each round finds every word's
lowest-rank pair by binary search over the sorted pair keys, merges all its
occurrences from the left, and drops words that have none left.

Merging all occurrences in one round equals merging them one by one only if no
merge that uses a token comes before the merge that makes it; the loader checks
this and otherwise merges one occurrence a round.

Null text counts as empty (no ids). Very long words take more rounds, never
more memory than a few arrays of their length; very long texts are cut into words
like others. Of pairs of equal rank the leftmost is merged first. Repeated rows are
rows each, an empty table gives an empty result, and columns of any names stay but
those that the ids and the decoded text are to have."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import threading
import time
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formsift.llm.common import prepare, tokenizer_file

NONE = np.iinfo(np.int32).max
#: Words kept with their ids in a worker, and the longest such word in bytes.
MEMO_WORDS, MEMO_BYTES = 400_000, 64
HOT_WORDS, IDLE_S = 10_000, 5.0
#: Symbols in one flat array.
ROUND_SYMBOLS = 2_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


def normalize(text: str) -> str:
    """Composed and lower case, each character by itself."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class NumpyBpe:
    """A word-end BPE with byte letters, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens = [""] * self.size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + end] for c in letters], np.int64)
        best: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            best.setdefault(vocab[a] * self.size + vocab[b], (rank, vocab[a + b]))
        self.keys = np.array(sorted(best), np.int64)
        self.ranks = np.array([best[k][0] for k in self.keys.tolist()], np.int32)
        self.made = np.array([best[k][1] for k in self.keys.tolist()], np.int64)
        first = np.full(self.size, NONE, np.int64)
        np.minimum.at(first, self.keys // self.size, self.ranks)
        np.minimum.at(first, self.keys % self.size, self.ranks)
        self.all_at_once = bool((first[self.made] > self.ranks).all())
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        out: list[bytes] = [b""] * len(words)
        at = 0
        while at < len(words):
            upto, n = at, 0
            while upto < len(words) and (upto == at or n + len(words[upto]) <= ROUND_SYMBOLS):
                n += len(words[upto])
                upto += 1
            self._rounds(words, at, upto, out)
            at = upto
        return out

    def _rounds(self, words: list[bytes], at: int, upto: int, out: list[bytes]) -> None:
        size = np.fromiter(map(len, words[at:upto]), np.int64, upto - at)
        raw = np.frombuffer(b"".join(words[at:upto]), np.uint8)
        word = np.arange(at, upto)[size > 0]
        size = size[size > 0]
        ends = np.cumsum(size)
        sym = self.inner[raw]
        sym[ends - 1] = self.final[raw[ends - 1]]
        while len(word):
            ends = np.cumsum(size)
            starts = ends - size
            key = np.empty(len(sym), np.int64)
            key[:-1] = sym[:-1] * self.size + sym[1:]
            key[ends - 1] = -1
            pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[pos] == key, self.ranks[pos], NONE)
            low = np.minimum.reduceat(rank, starts)
            done = low == NONE
            if done.any():
                ids = sym.astype("<u4")
                for w, s, e in zip(word[done].tolist(), starts[done].tolist(), ends[done].tolist()):
                    out[w] = ids[s:e].tobytes()
                keep = np.repeat(~done, size)
                sym, rank, pos = sym[keep], rank[keep], pos[keep]
                word, size, low = word[~done], size[~done], low[~done]
                if not len(word):
                    return
                starts = np.cumsum(size) - size
            of = np.repeat(np.arange(len(word)), size)
            hit = rank == low[of]
            if self.all_at_once:  # of touching occurrences, every second one
                i = np.arange(len(hit))
                gap = np.maximum.accumulate(np.where(hit, -1, i))
                hit &= (i - gap) % 2 == 1
            else:
                first = np.flatnonzero(hit)
                first = first[np.unique(of[first], return_index=True)[1]]
                hit = np.zeros(len(hit), bool)
                hit[first] = True
            sym = np.where(hit, self.made[pos], sym)
            gone = np.zeros(len(hit), bool)
            gone[1:] = hit[:-1]
            size = size - np.bincount(of[gone], minlength=len(word))
            sym = sym[~gone]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that hold no white space of ASCII."""
        pieces: list[bytes] = []
        plan: list[list[int]] = []
        for w in words:
            parts: list[int] = []
            text = w.decode("utf-8", "replace")
            for k, part in enumerate(self.split_special.split(text) if self.split_special else [text]):
                if k % 2:
                    parts.append(-1 - self.special[part])
                    continue
                for p in self.pieces.findall(normalize(part)):
                    parts.append(len(pieces))
                    pieces.append(p.encode())
            plan.append(parts)
        ids = self.merge(pieces)
        return [b"".join(ids[p] if p >= 0 else np.uint32(-1 - p).tobytes() for p in parts) for parts in plan]

    def decode(self, ids) -> str:
        """Tokens joined by one space, as a file without a decoder asks for."""
        return " ".join(map(self.tokens.__getitem__, ids))


class WordMemo:
    """Ids of whole texts from the ids of their words, each word encoded once in
    a worker. encode takes a list of byte words; split cuts a text into words
    whose ids, joined, are the text's.

    The first words, mostly the frequent ones, are kept in a small table that
    stays in the processor's cache; the large table takes a bounded number of
    words; once full it stays as it is, until so many words missed that both
    start anew. A worker that waits for work gives the tables' memory back after
    IDLE_S seconds, so that other stages of its executor have it."""

    def __init__(self, encode, split, forget=lambda: None, limit=MEMO_WORDS):
        self.encode, self.split, self.forget, self.limit = encode, split, forget, limit
        self.hot, self.known, self.missed = {}, {}, 0
        self.lock, self.watch, self.used = threading.Lock(), None, 0.0

    def texts(self, texts: list[str | None]) -> list[bytes]:
        with self.lock:
            out = self._texts(texts)
            self.used = time.monotonic()
            if self.watch is None:
                self.watch = threading.Thread(target=self._wait, daemon=True)
                self.watch.start()
            return out

    def _wait(self) -> None:
        while True:
            time.sleep(1)
            with self.lock:
                if time.monotonic() - self.used > IDLE_S:
                    self.hot, self.known, self.missed, self.watch = {}, {}, 0, None
                    self.forget()
                    break
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    def _texts(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.split(t) if t else [] for t in texts]
        if self.missed > 4 * self.limit:
            self.hot, self.known, self.missed = {}, {}, 0
        words = list(chain.from_iterable(cut))
        ids = list(map(self.hot.get, words))
        cold = [i for i, x in enumerate(ids) if x is None]
        if cold:
            self._fill(words, ids, cold)
        out, at = [], 0
        for ws in cut:
            out.append(b"".join(ids[at : at + len(ws)]))
            at += len(ws)
        return out

    def _fill(self, words: list[bytes], ids: list[bytes | None], cold: list[int]) -> None:
        named = [words[i] for i in cold]
        found = list(map(self.known.get, named))
        lost = [k for k, x in enumerate(found) if x is None]
        if lost:
            new = list(dict.fromkeys([named[k] for k in lost]))
            made = {}
            for i in range(0, len(new), 50_000):
                part = new[i : i + 50_000]
                made.update(zip(part, self.encode(part), strict=True))
            for k in lost:
                found[k] = made[named[k]]
            if len(self.known) > self.limit:
                self.missed += len(new)
            else:
                self.known.update((w, x) for w, x in made.items() if len(w) <= MEMO_BYTES)
                if len(self.hot) < HOT_WORDS:
                    self.hot.update(self.known)
        for i, x in zip(cold, found):
            ids[i] = x


def ascii_words(text: str) -> list[bytes]:
    """Words between ASCII white space; A-Z in lower case unless a control string may be there."""
    raw = text.encode("utf-8", "replace")
    return (raw if b"<|" in raw else raw.lower()).split()


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def list_array(parts: list[bytes], width: int = 4, kind: pa.DataType | None = None) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // width for p in parts], out=offsets[1:])
    flat = pa.Array.from_buffers(kind or pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


_CODERS: dict[str, tuple[NumpyBpe, WordMemo]] = {}


def coder(path: str) -> tuple[NumpyBpe, WordMemo]:
    """One coder a worker and file."""
    if path not in _CODERS:
        bpe = NumpyBpe(tokenizer_file(path))
        _CODERS[path] = (bpe, WordMemo(bpe.encode_words, ascii_words))
    return _CODERS[path]


def bpe_roundtrip(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the ids of a text column and the text decoded from them.

    tokenizer: path of the tokenizer file, readable on every executor. Columns
    named like the outputs are replaced; all others are kept."""
    prepare(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in (ids, decoded)]
    names = [f.name for f in kept]

    def run(batches):
        bpe, memo = coder(tokenizer)
        for batch in batches:
            for part in slices(batch):
                found = memo.texts(part.column(part.schema.get_field_index(text)).to_pylist())
                back = [bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in found]
                cols = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*cols, list_array(found), pa.array(back, pa.string())], [*names, ids, decoded])

    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    source = df.select(*[f"`{n}`" for n in names])
    return source.mapInArrow(run, schema)


def roundtrip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    found = bpe_roundtrip(docs.select("doc_id", "text"), tokenizer)
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
