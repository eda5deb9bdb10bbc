"""SimHash near-duplicates through covering locality-sensitive hashing.

Fingerprint: A-Z in lower case, words between ASCII white space, shingles of
three words joined by spaces with repeats (fewer words: the whole sequence),
XXH64 with seed 42 of each; bit i is set if it is set in over half the hashes.
No words: zero. Null text counts as empty; a null doc_id is never the name of
a component that has another. Texts of any length give one number; a bit set in
exactly half the hashes is not set. Repeated rows are rows of one component. An
empty table gives an empty result; only the two columns named are read.

Links: fingerprints at most `radius` bits apart. Give each of the 64 bits a
non-zero code of radius + 1 bits; table v, for each non-zero v, keeps the bits
whose code has odd parity with v. The codes of at most radius differing bits
span less than the whole space, so some v is orthogonal to all of them and its
table keeps none of those bits: every pair within the radius collides in some
table, whatever the fingerprints.

Equal fingerprints are made one row first. Buckets are dealt by range of
(table, kept bits, fingerprint), so a large bucket spreads over tasks. A bucket
of at most BUCKET rows inside one task is compared directly. The rows of all
other buckets (large, or cut by a task's edge) take an exact way without pairs:
two fingerprints are within two bits if and only if they share a variant with
at most one bit changed, and at most 65 fingerprints share one.

Components: alternating large-star and small-star rounds on written edge tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formsift.llm.bpe import slices
from formsift.llm.common import Scratch, prepare, staged

RADIUS, BITS, SHINGLE, SEED = 2, 64, 3, 42
#: Rows of a bucket that are compared with each other directly.
BUCKET = 16


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Kept bits of each of the 2**(radius + 1) - 1 tables, as signed 64-bit numbers."""
    top = 1 << (radius + 1)
    code = [1 + i % (top - 1) for i in range(bits)]
    kept = [sum(1 << i for i in range(bits) if (code[i] & v).bit_count() % 2) for v in range(1, top)]
    return [m - (1 << 64) if m >> 63 else m for m in kept]


def bit_table() -> np.ndarray:
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


_BYTE_BITS = bit_table()


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of a text, in order and with repeats."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    return np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[: len(last)].tolist(), last.tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes; of none, zero."""
    if not len(hashes):
        return 0
    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(raw[:, p], minlength=256) @ _BYTE_BITS for p in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key columns, fp) of each row; fp as signed 64-bit. Only whole texts are read."""
    prepare(df.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = np.array([fingerprint(t or "", shingle) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], [key, "fp"])

    source = df.select(key, text)
    return source.mapInArrow(run, source.drop(text).withColumn("fp", F.lit(0).cast("bigint")).schema)


def bucket_links(rows: DataFrame, radius: int, most: int) -> DataFrame:
    """(a, b) links of rows (t, bucket, fp) sorted in each partition; b is null
    where a's bucket is large or touches the partition's edge."""

    def flush(run, a, whole_bucket, out):
        """Links of the sorted run of whole buckets."""
        if not len(a):
            return
        same = np.concatenate([[False], run[1:] == run[:-1]])
        sizes = np.diff(np.append(np.flatnonzero(~same), len(a)))
        big = np.repeat(sizes > most, sizes)
        for x in a[big].tolist():
            out.append((x, None))
        small, ids = a[~big], np.repeat(np.arange(len(sizes)), sizes)[~big]
        for lag in range(1, most):
            if lag >= len(small):
                break
            near = np.flatnonzero(ids[lag:] == ids[:-lag])
            if not len(near):
                break
            far = np.bitwise_count((small[near] ^ small[near + lag]).view(np.uint64))
            hit = near[far <= radius]
            out.extend(zip(small[hit].tolist(), small[hit + lag].tolist()))

    def run(batches):
        held = None  # rows of the last bucket seen, (key, fp); edge: it is the partition's first
        edge, over = True, False
        for batch in batches:
            t, k, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            key = np.rec.fromarrays([t, k])
            out: list[tuple[int, int | None]] = []
            at = 0
            if held is not None:
                stop = len(fp) if key[-1] == held[0] else int(np.argmax(key != held[0]))
                mine, at = fp[:stop], stop
                if over or edge or len(held[1]) + len(mine) > most:
                    out += [(x, None) for x in [*held[1].tolist(), *mine.tolist()]]
                    held = (held[0], held[1][:0])
                    over = True
                else:
                    held = (held[0], np.concatenate([held[1], mine]))
                if at < len(fp):
                    if len(held[1]):
                        flush(np.zeros(len(held[1])), held[1], True, out)
                    held, edge, over = None, False, False
            if at < len(fp):
                rest, a = key[at:], fp[at:]
                new = np.append(True, rest[1:] != rest[:-1])
                first = np.flatnonzero(new)
                tail = int(first[-1])
                head = 0
                if edge:  # the partition's first bucket
                    head = int(first[1]) if len(first) > 1 else tail
                    out += [(x, None) for x in a[:head].tolist()]
                edge = edge and tail == 0
                flush(np.cumsum(new)[head:tail], a[head:tail], True, out)
                held = (rest[tail], a[tail:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
        if held is not None and len(held[1]):  # the last bucket touches the edge
            yield pa.RecordBatch.from_arrays([pa.array(held[1], pa.int64()), pa.nulls(len(held[1]), pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def links(prints: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """(a, b) links, a < b, among distinct fingerprints (column fp) that connect
    all that are within the radius; radius is at most 2 here."""
    if radius > 2:
        raise ValueError("the exact way for large buckets covers two bits")
    spark = prints.sparkSession
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("k")) for i, m in enumerate(masks(radius))]))
    dealt = prints.select("fp", tables.alias("x")).select("x.t", "x.k", "fp")
    # Range dealing: a bucket larger than a partition spreads over several.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = staged(bucket_links(dealt.repartitionByRange(parts, "t", "k", "fp").sortWithinPartitions("t", "k", "fp"), radius, most), "links")
    rest = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    flips = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")) for i in range(BITS)]]
    if radius < 2:
        flips = flips[:1] if radius == 0 else flips
    shared = rest.select("fp", F.explode(F.array(*flips)).alias("variant")).groupBy("variant").agg(F.collect_set("fp").alias("fps"))  # 65 at most
    star = shared.where("size(fps) > 1").select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    if radius == 1:
        star = star.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 1)
    direct = found.where("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return direct.union(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component, for each node with an edge
    (a < b). Written; of the rounds' tables only the last stays while it is read."""
    with Scratch(edges.sparkSession, "components") as scratch:
        now = scratch.write(edges.select("a", "b"), "edges")
        mark = None
        while True:
            size = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("a", "b").cast("bigint")).alias("h"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
            if size == mark:
                return staged(now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a"), F.col("a")).distinct()), "roots")
            mark = size
            # Large star: each node's larger neighbours join its smallest neighbour (or itself).
            both = now.union(now.select(F.col("b"), F.col("a")))
            low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
            up = now.join(low, F.col("a") == F.col("u")).select(F.least("u", "m").alias("a"), "b").distinct()
            # Small star: each node and its smaller neighbours join the smallest of them.
            low = up.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
            down = up.join(low, F.col("b") == F.col("u")).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
            last, now = now, scratch.write(down.where("a < b").distinct(), "edges")
            scratch.drop(last)


def groups(prints: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(fp, component): the smallest key among all rows of linked fingerprints."""
    own = staged(prints.groupBy("fp").agg(F.min(key).alias("low")), "prints")
    roots = components(links(own.select("fp"), radius))
    named = roots.join(own, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("low").alias("name"))
    linked = roots.join(named, "root").select("node", "name", F.lit(True).alias("linked"))
    return own.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.when(F.col("linked"), F.col("name")).otherwise(F.col("low")).alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each document."""
    prints = staged(fingerprints(docs), "fingerprints")
    # Written, so that each side of the join is dealt by itself and many equal fingerprints can be split.
    named = staged(groups(prints), "groups").withColumnRenamed("fp", "group_fp")
    joined = prints.join(named, F.col("fp") == F.col("group_fp"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
