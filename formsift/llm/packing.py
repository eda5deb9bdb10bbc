"""Packing by shortest-pack-first over the length histogram.

1. Each document becomes ids plus an end id, cut into full sequences and one
   rest. A piece is (part, length, rank within part and length), a part being
   one task's share of the documents.
2. The histogram of lengths has at most max_len bins, whatever the corpus. The
   driver places lengths longest first, each into the emptiest pattern it fits,
   and updates the patterns' counts; then it dissolves the emptiest patterns
   and cuts their pieces to fill the gaps of the others (documents may be cut
   freely), so that padding is left in one sequence at most.
3. A length's pieces have ranks 0, 1, ...: rank within the part plus a base by
   (part, length). Patterns take rank ranges, so a join by length and rank
   range brings each piece its sequence and offset. No length, however common,
   meets in one task.

Null text counts as empty (just the end id); a null key stays null; repeated
rows are separate documents. A text of any length is cut into pieces of max_len.
Pieces of one length are ranked by part and place, so ties don't arise. An empty
table gives no pieces. Only the two columns named are read."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formsift.llm.bpe import slices
from formsift.llm.common import prepare, staged
from formsift.llm.tokenfiles import library_memo

MAX_LEN = 1024
#: Words and model words kept in a worker: this stage has no sort or shuffle beside it.
PACKING_WORDS, PACKING_PIECES = 800_000, 400_000
SLOTS = "length int, rank_from bigint, rank_to bigint, cut_from int, cut_len int, sequence_base bigint, offset int"


def shortest_pack_first(histogram: dict[int, int], max_len: int) -> list[tuple[int, list[int]]]:
    """(count, lengths) of each pattern. Lengths come longest first; each goes
    into the pattern with most room, or opens a new one."""
    heap: list[tuple[int, int, int, tuple[int, ...]]] = []  # used, order, count, lengths
    full: list[tuple[int, list[int]]] = []
    order = 0
    for length in sorted(histogram, reverse=True):
        left, grown = histogram[length], []
        while left:
            if heap and heap[0][0] + length <= max_len:
                used, _, count, lengths = heapq.heappop(heap)
                n = min(left, count)
                grown.append((used + length, n, (*lengths, length)))
                if n < count:
                    order += 1
                    heapq.heappush(heap, (used, order, count - n, lengths))
                left -= n
            elif grown and grown[0][0] + length <= max_len:  # patterns grown by this very length
                for used, n, lengths in grown:
                    order += 1
                    heapq.heappush(heap, (used, order, n, lengths))
                grown = []
            else:
                grown.append((length, left, (length,)))
                left = 0
        for used, n, lengths in grown:
            if used == max_len:
                full.append((n, list(lengths)))
            else:
                order += 1
                heapq.heappush(heap, (used, order, n, lengths))
    return full + [(n, list(lengths)) for _, _, n, lengths in sorted(heap, reverse=True)]


def plan(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int, int, int]]:
    """Slots: pieces of a length with ranks in [rank_from, rank_to) give their
    ids [cut_from, cut_from + cut_len) to sequence (sequence_base + rank - rank_from)
    at offset. Sequence numbers and offsets have no gaps."""
    patterns = [(n, lengths, max_len - sum(lengths)) for n, lengths in shortest_pack_first(histogram, max_len)]
    patterns.sort(key=lambda p: p[2])
    gaps, donated = sum(n * g for n, _, g in patterns), []
    keep = list(patterns)
    while keep:  # dissolve the emptiest patterns while the others' gaps can take them
        n, lengths, gap = keep[-1]
        k = min(n, gaps // max_len)
        if gap == 0 or k == 0:
            break
        gaps -= k * max_len
        donated.append((k, lengths))
        keep.pop()
        if k < n:
            keep.append((n - k, lengths, gap))
            break
    taken: dict[int, int] = defaultdict(int)

    def ranks(length: int, n: int) -> int:
        taken[length] += n
        return taken[length] - n

    slots, sequence = [], 0
    open_gaps: list[list[int]] = []  # first sequence, count, offset, room
    for n, lengths, gap in keep:
        at = 0
        for length in lengths:
            first = ranks(length, n)
            slots.append((length, first, first + n, 0, length, sequence, at))
            at += length
        if gap:
            open_gaps.append([sequence, n, at, gap])
        sequence += n
    loose = [[length, ranks(length, n), n, 0] for n, lengths in donated for length in lengths]  # length, rank, count, cut so far
    while loose:
        length, rank, n, cut = loose.pop()
        first, m, at, room = open_gaps.pop()
        k, size = min(n, m), min(length - cut, room)
        slots.append((length, rank, rank + k, cut, size, first, at))
        if n > k:
            loose.append([length, rank + k, n - k, cut])
        if m > k:
            open_gaps.append([first + k, m - k, at, room])
        if cut + size < length:
            loose.append([length, rank, k, cut + size])
        if size < room:
            open_gaps.append([first, k, at + size, room - size])
    return slots


def token_pieces(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, max_len: int = MAX_LEN) -> DataFrame:
    """Pieces of at most max_len ids: key, start (ids of the document before it),
    length, doc_tokens, ids (little-endian 32-bit), part, part_rank. Written once."""
    prepare(df.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        memo, ranks, part_no = library_memo(tokenizer, PACKING_WORDS, PACKING_PIECES), defaultdict(int), None
        for batch in batches:
            for part in slices(batch):
                if part_no is None and part.num_rows:
                    part_no = part.column(2)[0].as_py()
                rows = []
                for k, ids in zip(part.column(0).to_pylist(), memo.texts(part.column(1).to_pylist())):
                    ids += end
                    for at in range(0, len(ids), 4 * max_len):
                        piece = ids[at : at + 4 * max_len]
                        n = len(piece) // 4
                        rows.append((k, at // 4, n, len(ids) // 4, piece, part_no, ranks[n]))
                        ranks[n] += 1
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "start", "length", "doc_tokens", "ids", "part", "part_rank"])

    source = df.select(F.col(key).cast("bigint"), text, F.spark_partition_id().cast("bigint").alias("part"))
    found = source.mapInArrow(run, "key bigint, start bigint, length int, doc_tokens bigint, ids binary, part bigint, part_rank bigint")
    return staged(found, "pieces")


def pack(pieces: DataFrame, max_len: int = MAX_LEN, only_if_cut: tuple[str, ...] = ()) -> DataFrame:
    """Add sequence_id, offset, cut_from and cut_len to pieces; those cut to fill
    gaps become several rows.

    All other columns are kept; start and length become the cut's own. Columns
    named in only_if_cut are null for lengths of which no piece is cut, so that
    they needn't be shuffled."""
    spark = pieces.sparkSession
    counts = staged(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = plan(histogram, max_len)
    cut_lengths = sorted({s[0] for s in placed if s[4] < s[0]})
    pieces = pieces.withColumns({c: F.when(F.col("length").isin(cut_lengths), F.col(c)) for c in only_if_cut})
    slots = spark.createDataFrame(placed, SLOTS).withColumnRenamed("length", "slot_length")
    by_part = F.expr("sum(n) OVER (PARTITION BY length ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    base = counts.select(F.col("part").alias("base_part"), F.col("length").alias("base_length"), F.coalesce(by_part, F.lit(0)).alias("base"))
    ranked = pieces.join(base, (F.col("part") == F.col("base_part")) & (F.col("length") == F.col("base_length")))
    ranked = ranked.withColumn("rank", F.col("base") + F.col("part_rank"))
    # As many slots as the histogram has bins and patterns: bounded by max_len, so they are sent to all.
    fits = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    placed = ranked.join(F.broadcast(slots), fits)
    own = {
        "start": F.col("start") + F.col("cut_from"),
        "length": F.col("cut_len").cast("bigint"),
        "sequence_id": F.col("sequence_base") + F.col("rank") - F.col("rank_from"),
        "offset": F.col("offset").cast("bigint"),
    }
    return placed.withColumns(own).drop("base_part", "base_length", "base", "slot_length", "rank_from", "rank_to", "sequence_base", "part", "part_rank", "rank")


def packed_rows(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece.

    A piece that is not cut has its checksum from the written pieces, before the
    join; only pieces that gaps may cut carry their ids through it."""
    pieces = token_pieces(docs, tokenizer, max_len=max_len)
    placed = pack(pieces.withColumn("ids_crc32", F.crc32("ids")), max_len, only_if_cut=("ids",))
    cut = F.crc32(F.expr("substring(ids, 4 * cut_from + 1, 4 * cut_len)"))
    crc = F.when(F.col("ids").isNull(), F.col("ids_crc32")).otherwise(cut)
    return placed.select(F.col("key").alias("doc_id"), "start", "length", crc.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def packing_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    return packed_rows(docs, tokenizer)
