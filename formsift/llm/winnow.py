"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; of each window of w hashes the
smallest is chosen, the rightmost of equal ones; its position is kept. Any
match of at least w + k - 1 code points shares a chosen hash. Texts of fewer
than k code points have one gram, the whole text; empty or null texts have none.
Texts of one gram to w grams count as one window. Long texts are worked
through in blocks, with the same result. Repeated rows have equal fingerprints; an
empty table gives an empty result; columns of any names stay but those that the
positions and hashes are to have. In the order by key, rows of one key stand
together and are worked through by one task, as a stream."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formsift.llm.bpe import list_array, slices
from formsift.llm.common import bounds_array, order_bounds, prepare, shard_of

GRAM, WINDOW = 16, 32
BLOCK = 1 << 20
#: Bytes of text in one shard of the order by key.
SHARD_BYTES = 16 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)

_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 14)
        for name, factor in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-gram: a rolling polynomial from running sums, then mixed."""
    n = len(points)
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * up[k - 1 : n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the minima of all windows of w hashes, rightmost of equals, ascending."""
    if len(h) <= w:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
    best, span = np.arange(len(h)), 1
    while span < w:  # minima of spans 2, 4, ... and at last w, from two that overlap
        step = min(span, w - span)
        a, b = best[:-step], best[step:]
        best = np.where(h[b] <= h[a], b, a)
        span += step
    return best[np.flatnonzero(np.diff(best, prepend=-1))]


def winnow(text: str, k: int = GRAM, w: int = WINDOW, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of a text's fingerprint, positions ascending."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    k = min(k, len(points))
    if len(points) <= block + w + k:
        h = gram_hashes(points, k)
        at = window_minima(h, w)
        return at, h[at]
    places, hashes = [], []
    for start in range(0, len(points) - k - w + 2, block):
        h = gram_hashes(points[start : start + block + w + k - 2], k)
        at = window_minima(h, w)
        places.append(at + start)
        hashes.append(h[at])
    at, h = np.concatenate(places), np.concatenate(hashes)
    keep = np.flatnonzero(np.diff(at, prepend=-1))
    return at[keep], h[keep]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes; of two empty ones 1."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(positions: np.ndarray, hashes: np.ndarray) -> str:
    return hashlib.sha256(positions.astype("<u8").tobytes() + hashes.astype("<u8").tobytes()).hexdigest()[:32]


def winnow_column(df: DataFrame, text: str = "text", k: int = GRAM, w: int = WINDOW, positions: str = "positions", hashes: str = "hashes") -> DataFrame:
    """Add the positions and hashes (as signed 64-bit) of each text's fingerprint."""
    prepare(df.sparkSession)
    kept = [c for c in df.columns if c not in (positions, hashes)]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = [winnow(t or "", k, w) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                extra = [list_array([x[i].astype("<i8").tobytes() for x in found], 8, pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], *extra], [*kept, positions, hashes])

    source = df.select(*[f"`{c}`" for c in kept])
    schema = source.withColumns({positions: F.lit(None).cast("array<bigint>"), hashes: F.lit(None).cast("array<bigint>")}).schema
    return source.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many first code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_pairs(docs: DataFrame, k: int = GRAM, w: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    The order is by doc_id (nulls first, ties by text); the last document's next
    is the first. Documents are dealt into ranges of doc_id once; the documents
    at each range's first key also go to the range before, where they only serve
    as the last one's next. Null text counts as empty."""
    spark = prepare(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = order_bounds(source, "doc_id", "text", shard_bytes)
    ends = source.agg(F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    low = None if ends["nulls"] else ends["low"]
    bounds = [b for b in bounds if low is None or b > low]
    ordered = peeking(source, low, bounds)

    def run(batches):
        held, last = None, False  # the document whose next is to come
        for batch in batches:
            for part in slices(batch):
                rows = []
                for key, text, peek in zip(*(part.column(i).to_pylist() for i in range(3))):
                    if last or (peek and held is None):
                        continue
                    own = winnow(text, k, w)
                    if held is not None:
                        rows.append(compare(*held, text, own))
                    held, last = (key, text, own), peek
                if rows:
                    yield table(rows)

    def compare(key, text, own, following, others):
        other = edited(text, following)
        changed = winnow(other, k, w)
        mine = np.unique(own[1])
        sha = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
        return key, len(text), sha, digest(*own), digest(*changed), likeness(mine, np.unique(changed[1])), likeness(mine, np.unique(others[1]))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def table(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return ordered.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def peeking(source: DataFrame, low: int | None, bounds: list[int]) -> DataFrame:
    """(doc_id, text, peek) in order by shard: with peek, copies of the documents
    that begin the next shard (for the last shard: the whole order) at the end."""
    shards = len(bounds) + 1
    begins = F.col("doc_id").eqNullSafe(F.lit(low).cast("bigint"))
    if bounds:
        begins = begins | F.coalesce(F.col("doc_id") == F.try_element_at(bounds_array(bounds), F.greatest(F.col("shard"), F.lit(1))), F.lit(False))
    own = F.struct(F.col("shard").alias("to"), F.lit(False).alias("peek"))
    before = F.struct(F.pmod(F.col("shard") - 1, F.lit(shards)).cast("int").alias("to"), F.lit(True).alias("peek"))
    dealt = source.withColumn("shard", shard_of("doc_id", bounds)).withColumn("deal", F.explode(F.when(begins, F.array(own, before)).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "text", F.col("deal.peek").alias("peek"), F.col("deal.to").alias("to"))
    return dealt.repartitionById(shards, F.col("to")).sortWithinPartitions("peek", F.asc_nulls_first("doc_id"), "text").select("doc_id", "text", "peek")
