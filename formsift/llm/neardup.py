"""Near-duplicates by SimHash, confirmed and completed by shingle similarity.

Words as in simhash; a text's set holds the hashes of its shingles of five words
(fewer words: the whole sequence; none: the empty set). Two texts are linked if
the Jaccard similarity of their sets is 0.8 or more; texts of equal sets are one.

Candidates come from two places. Covering tables over the SimHash of the same
shingles bring together what differs by at most two bits, most copies and crowds
of near copies. Two bits leave out most texts of similarity 0.8, so an exact way
finds the rest: order all hashes by how often they occur, rare ones first. Of n
hashes two linked texts share one among the first n - ceil(0.8 n) + 1 of each,
so buckets of these prefixes hold every linked pair. Any order will do for that;
counts are kept in SLOTS sums, whatever the size of the input, and only make
common hashes rare in prefixes. What precedes the first shared hash differs,
which rules out most of them. All candidates are confirmed on the whole sets, once
a sketch of each set (parities of its hashes by SKETCH slots, whose differences are
never more than those of the sets) has left out what can't be similar.

A bucket of over BUCKET sets is not paired out: all are compared with LEADERS of
its sets and components are taken; what is then still in different components
is compared in full. So a crowd of near copies costs a multiple of its size.

Null text counts as empty, and texts without words are one group; a null key is
less than any other. Very long texts have long sets but no other path. Repeated
rows are one. An empty table gives an empty result. Columns of any names stay."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formsift.llm.bpe import list_array, slices
from formsift.llm.common import Scratch, fresh, prepare, staged
from formsift.llm.simhash import SEED, components, links, majority, shingle_hashes

SHINGLE = 5
#: Similarity asked for, as a fraction.
PART, WHOLE = 4, 5
SLOTS, BLOCKS, DEALS, LEAST_BITS, MOST_BITS = 1 << 18, 64, 32, 1 << 22, 1 << 28
BUCKET, LEADERS, SALTS, SKETCH = 32, 8, 64, 1024
#: Constants whose xor gives each leader its own order.
TURNS = [(0x9E3779B97F4A7C15 * i) % (1 << 63) for i in range(LEADERS)]


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The set of a text's hashes, ascending, as signed 64-bit numbers."""
    return np.unique(hashes.view(np.int64))


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    return distinct(shingle_hashes(text, shingle))


def set_name(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(found.tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def slot_counts(docs: DataFrame, text: str) -> np.ndarray:
    """How many sets hold a hash of each slot. A task gives its counts as BLOCKS
    binary rows, which are added up in two steps, so no task reads them all."""
    width = SLOTS // BLOCKS
    kinds = "block int, deal int, counts binary"

    def rows(sums: dict[int, np.ndarray], deal: int):
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([deal] * len(sums), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], ["block", "deal", "counts"])

    def count(batches):
        counts, deal = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for part in slices(batch):
                deal = part.column(1)[0].as_py() if part.num_rows else deal
                for t in part.column(0).to_pylist():
                    np.add.at(counts, shingle_set(t or "") & (SLOTS - 1), 1)
        yield from rows({i: counts[i * width : (i + 1) * width] for i in range(BLOCKS)}, deal)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                found = np.frombuffer(counts, "<i8")
                sums[block] = sums[block] + found if block in sums else found
        yield from rows(sums, 0)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = docs.select(text, F.pmod(F.spark_partition_id(), F.lit(DEALS)).alias("deal")).mapInArrow(count, kinds)
    some = made.repartition(parts, "block", "deal").mapInArrow(add, kinds)
    out = np.zeros((BLOCKS, width), np.int64)
    for r in some.repartition(BLOCKS, "block").mapInArrow(add, kinds).collect():
        out[r["block"]] += np.frombuffer(bytes(r["counts"]), "<i8")
    return out.reshape(-1)


def prefix(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    n = len(found)
    if not n:
        return found
    most = n - -(-n * PART // WHOLE) + 1
    return found[np.lexsort((found, counts[found & (SLOTS - 1)]))[:most]]


def sketch(found: np.ndarray) -> bytes:
    """Parities of the hashes in SKETCH slots."""
    odd = np.bincount((found >> 20) & (SKETCH - 1), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def named(docs: DataFrame, key: str, text: str, counts: np.ndarray) -> DataFrame:
    """(key, s, n, fp, sketch, tokens): name, size, SimHash and sketch of each text's
    set, and its prefix, unless the task has just met the same set."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                hashes = [shingle_hashes(t or "", SHINGLE) for t in part.column(1).to_pylist()]
                prints = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
                sets = [distinct(h) for h in hashes]
                names = [set_name(x) for x in sets]
                first = []
                for name, x in zip(names, sets):
                    first.append(x[:0] if name in seen else prefix(x, counts))
                    seen.add(name)
                if len(seen) > 200_000:
                    seen.clear()
                sketches = list_array([sketch(x) for x in sets], 8, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array(prints), sketches, pa.array(first, pa.list_(pa.int64()))], [key, "s", "n", "fp", "sketch", "tokens"]
                )

    source = docs.select(key, text)
    longs = F.array().cast("array<bigint>")
    empty = {"s": F.lit(0).cast("bigint"), "n": F.lit(0), "fp": F.lit(0).cast("bigint"), "sketch": longs, "tokens": longs}
    return source.mapInArrow(run, source.drop(text).withColumns(empty).schema)


def possible(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and sketches leave it open that they are similar."""
    one = names.select(F.col("s").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("x"))
    two = names.select(F.col("s").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("y"))
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    sizes = F.least("n_a", "n_b") * WHOLE >= F.greatest("n_a", "n_b") * PART
    return pairs.join(one, "a").join(two, "b").where(sizes & (apart * (PART + WHOLE) <= (F.col("n_a") + F.col("n_b")) * (WHOLE - PART))).select("a", "b")


def print_pairs(ids: DataFrame) -> DataFrame:
    """(a, b) sets of SimHash at most two bits apart, as chains: all sets of a
    fingerprint hang on its least, and those on each other by the covering tables."""
    both = ids.select("s", "fp").distinct()
    least = both.groupBy("fp").agg(F.min("s").alias("lead"))
    same = both.join(least, "fp").where("s <> lead").select(F.col("lead").alias("a"), F.col("s").alias("b"))
    near = links(least.select("fp"))
    one, two = least.select(F.col("fp").alias("a"), F.col("lead").alias("x")), least.select(F.col("fp").alias("b"), F.col("lead").alias("y"))
    return same.union(near.join(one, "a").join(two, "b").select(F.least("x", "y"), F.greatest("x", "y")))


def may_link(n, i, m, j):
    """Whether sets of sizes n and m can be similar enough if the first hash they
    share is the i-th of one and the j-th of the other (from 0): what precedes it
    differs, and so does at least the difference of what follows."""
    apart = n - i - m + j
    return (i + j + (F.abs(apart) if isinstance(apart, Column) else np.abs(apart))) * (PART + WHOLE) <= (n + m) * (WHOLE - PART)


def bucket_pairs(rows: DataFrame, most: int) -> DataFrame:
    """(a, b) of buckets of at most `most` rows (token, salt, s, n, i), which lie
    sorted in each partition; (a, null) with token, n and i of the rows of others."""

    def run(batches):
        held = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            token, salt, s, n, i = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            cut = int(np.searchsorted(token, token[-1])) if len(token) else 0
            held = [x[cut:] for x in (token, salt, s, n, i)]
            yield from out(token[:cut], salt[:cut], s[:cut], n[:cut], i[:cut])
        if held is not None:
            yield from out(*held)

    def out(token, salt, s, n, i):
        if not len(token):
            return
        # One row a set and token: equal sets of different tasks stand together.
        one = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (s[1:] != s[:-1])))
        token, salt, s, n, i = token[one], salt[one], s[one], n[one], i[one]
        new = np.append(True, token[1:] != token[:-1])
        sizes = np.diff(np.append(np.flatnonzero(new), len(token)))
        ids = np.repeat(np.arange(len(sizes)), sizes)
        large = np.repeat(sizes > most, sizes) | (salt >= 0)
        a, b = [], []
        token_l, s_l, n_l, i_l = token[large], s[large], n[large], i[large]
        ids, s, n, i = ids[~large], s[~large], n[~large].astype(np.int64), i[~large].astype(np.int64)
        for lag in range(1, most):
            at = np.flatnonzero(ids[lag:] == ids[:-lag])
            if not len(at):
                break
            at = at[may_link(n[at], i[at], n[at + lag], i[at + lag])]
            a.append(np.minimum(s[at], s[at + lag]))
            b.append(np.maximum(s[at], s[at + lag]))
        names = ["a", "b", "token", "n", "i"]
        if a and len(one := np.concatenate(a)):
            two = np.concatenate(b)
            both = np.unique(np.stack([one, two]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.nulls(both.shape[1], pa.int64()), *[pa.nulls(both.shape[1], pa.int32())] * 2], names)
        if len(s_l):
            yield pa.RecordBatch.from_arrays([pa.array(s_l), pa.nulls(len(s_l), pa.int64()), pa.array(token_l), pa.array(n_l, pa.int32()), pa.array(i_l, pa.int32())], names)

    return rows.mapInArrow(run, "a bigint, b bigint, token bigint, n int, i int")


def needed_filter(found: DataFrame) -> np.ndarray:
    """Bits of the names in found (column s); a set bit may stand for several. As
    many bits as suit their number, MOST_BITS (32 MiB) at most: then more pass than need."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * found.count()).bit_length()))
    at = F.col("s").bitwiseAND(F.lit(size - 1).cast("bigint"))
    rows = found.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toLocalIterator()
    out = np.zeros(size + (1 << 16), bool)
    for r in rows:
        # Bucket k begins at (k - 1) * 32768; position 0 belongs to bucket 0.
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        start = max(0, r["k"] - 1) * 32768 + (1 if r["k"] else 0)
        out[start : start + len(bits)] |= bits.astype(bool)
    return np.packbits(out[:size])


def whole_sets(docs: DataFrame, text: str, needed: np.ndarray) -> DataFrame:
    """(s, tokens) of the sets that pass the filter."""
    last = len(needed) * 8 - 1

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(t or "") for t in part.column(0).to_pylist()]
                kept = [(h, x) for x in sets for h in [set_name(x)] if needed[(h & last) >> 3] >> (7 - (h & 7)) & 1]
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.list_(pa.int64()))], ["s", "tokens"])

    return docs.select(text).mapInArrow(run, "s bigint, tokens array<bigint>").dropDuplicates(["s"])


def confirmed(pairs: DataFrame, docs: DataFrame, text: str, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough; written."""
    needed = needed_filter(pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct())
    sets = scratch.write(whole_sets(docs, text, needed), "whole")
    one = sets.select(F.col("s").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("s").alias("b"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    out = pairs.join(one, "a").join(two, "b").where(both * (PART + WHOLE) >= (F.size("x") + F.size("y")) * PART).select("a", "b")
    out = scratch.write(out, "similar")
    scratch.drop(sets)
    return out


def similar_groups(docs: DataFrame, key: str, text: str, most: int = BUCKET) -> DataFrame:
    """(component): the smallest key of each group of near-duplicates."""
    spark = prepare(docs.sparkSession)
    counts = slot_counts(docs, text)
    usual = 1000 + 2 * int(counts.mean())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark, "similar") as scratch:
        ids = scratch.write(named(docs, key, text, counts), "sets")
        own = scratch.write(ids.groupBy("s").agg(F.min(key).alias("low"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "names")
        hot = np.flatnonzero(counts > usual)
        common = F.array_contains(F.lit([int(x) for x in hot]), F.col("token").bitwiseAND(F.lit(SLOTS - 1).cast("bigint"))) if len(hot) else F.lit(False)
        rows = ids.select("s", "n", F.posexplode("tokens").alias("i", "token"))
        rows = rows.select("token", F.when(common, F.pmod("s", F.lit(SALTS))).otherwise(F.lit(-1)).cast("int").alias("salt"), "s", "n", "i")
        dealt = rows.repartition(parts, "token", "salt").sortWithinPartitions("token", "s")
        found = scratch.write(bucket_pairs(dealt, most), "pairs")
        prints = scratch.write(print_pairs(ids), "prints")
        scratch.drop(ids)
        direct = found.where("b IS NOT NULL").select("a", "b").union(prints)
        large = found.where("b IS NULL").select("token", F.col("a").alias("s"), "n", "i")
        # Those with the fewest rarer hashes are nearest to all others of a crowd.
        turned = [F.col("s").bitwiseXOR(F.lit(t).cast("bigint")) for t in TURNS]
        first = large.groupBy("token").agg(F.array(*[F.min(F.struct("i", x.alias("s")))["s"].bitwiseXOR(F.lit(t).cast("bigint")) for x, t in zip(turned, TURNS)]).alias("leaders"))
        led = large.join(scratch.write(first, "leaders"), "token").select("s", F.explode(F.array_distinct("leaders")).alias("l")).where("s <> l")
        led = led.select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b"))
        pairs = scratch.write(possible(direct.union(led).distinct(), own), "candidates")
        edges = confirmed(pairs, docs, text, scratch)
        # What leaders left in different components is compared in full.
        roots = components(edges)
        placed = large.join(roots, F.col("s") == F.col("node"), "left").select("token", "s", "n", "i", F.coalesce("root", "s").alias("c"))
        split = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
        split = scratch.write(placed.join(split, "token"), "split")
        a, b = split.alias("a"), split.alias("b")
        apart = (F.col("a.token") == F.col("b.token")) & (F.col("a.s") < F.col("b.s")) & (F.col("a.c") != F.col("b.c")) & may_link(*[F.col(x) for x in ("a.n", "a.i", "b.n", "b.i")])
        late = a.join(b, apart).select(F.col("a.s").alias("a"), F.col("b.s").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
        late = scratch.write(possible(late, own), "late")
        if not late.isEmpty():
            roots = components(edges.union(confirmed(late, docs, text, scratch)))
        groups = own.join(roots, F.col("s") == F.col("node"), "left").groupBy(F.coalesce("root", "s")).agg(F.min("low").alias("component"))
        return staged(groups.select("component"), "groups")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest key
    (null first), then the smallest text hash; of rows equal in both, one. All
    columns stay, whatever their names."""
    # try_add: a nullable hash, as in the written table, so that keys need no cast.
    who = F.struct(F.col(key).alias("k"), F.try_add(F.xxhash64(text), F.lit(0).cast("bigint")).alias("h"))
    mark, keeper = fresh(docs, "who", "keeper")
    keepers = similar_groups(docs.select(who.alias("who"), F.col(text).alias("text")), "who", "text").select(F.col("component").alias(keeper))
    # Joined and made distinct by the same column, so the texts are dealt once.
    marked = docs.withColumn(mark, who)
    return marked.join(keepers, F.col(mark) == F.col(keeper), "left_semi").dropDuplicates([mark]).drop(mark)
