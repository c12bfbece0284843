"""SimHash near-duplicates by meeting in the middle.

Two fingerprints differ in at most 2r bits exactly if some value lies within r bits of both, so
every fingerprint emits all values of its ball of radius r and equal values meet. The balls
are shuffled in factored form: a row stands for all variants of one fingerprint that share their top
PREFIX bits, with the number of flips left for the other bits. Rows meet by prefix, and
the receiving task writes out the variants, sorts them and links the fingerprints that meet to
the least of them. Prefixes with many rows are dealt again by the next bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialize, skew_join
from codeloom.llm.components import components

PREFIX = 12  # bits of either level of prefixes
SEED = 42
CHUNK = 1 << 16  # shingles counted at a time
LANES = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """For each row of hashes and each of the 64 bits, in how many hashes it is set; eight byte-wide counters to a word."""
    out = np.zeros((len(hashes), 64), np.int64)
    for first in range(0, hashes.shape[1], CHUNK):
        part = hashes[:, first : first + CHUNK]
        groups = np.arange(0, part.shape[1], 255)  # a counter holds 255 at most
        for shift in range(8):
            packed = np.add.reduceat((part >> np.uint64(shift)) & LANES, groups, axis=1)
            out[:, shift::8] += packed.view(np.uint8).reshape(len(hashes), -1, 8).sum(axis=1, dtype=np.int64)
    return out


def shingle_hashes(text: bytes | None, shingle: int = 4, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle of a UTF-8 text, in lower case; of the whole sequence if it is shorter."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(shingle, len(words))
    count = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:count].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, count)


def remixed(hashes: np.ndarray, rows: int) -> np.ndarray:
    """Independent hashes of the same shingles, so many rows; the first has them as they are."""
    steps = np.array([row * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for row in range(1, rows)], np.uint64)
    x = hashes + steps[:, None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.concatenate([hashes[None, :], x ^ (x >> np.uint64(31))])


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of hashes: a bit is 1 that is set in over half of them."""
    most = 2 * bit_counts(hashes) > hashes.shape[1]
    return np.packbits(most, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = SEED) -> int:
    """SimHash of the word shingles of a UTF-8 text, as an unsigned 64-bit integer."""
    return int(majority_bits(shingle_hashes(text, shingle, seed)[None, :])[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, row (hash of doc_id and text) and fp (the fingerprint's bits as a signed long)."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in batch["text"].to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], pa.array(fps.view(np.int64))], ["doc_id", "row", "fp"])

    return named_texts(docs).mapInArrow(run, "doc_id long, row long, fp long")


def named_texts(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of doc_id and text) and text as bytes."""
    text = F.col("text").cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row"), text)


def flip_masks(positions: range, most: int) -> list[int]:
    """All values with at most ``most`` bits set among the positions, as signed 64-bit integers."""
    masks = [sum(1 << p for p in chosen) for k in range(most + 1) for chosen in combinations(positions, k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _ball_rows(fps: DataFrame, radius: int, hot_rows: int, bits: int) -> DataFrame:
    """key and fp: the variants of fp whose top bits are the key's; ``_unpacked`` tells the flips that are left."""
    top = F.array(*map(F.lit, flip_masks(range(64 - PREFIX, 64), radius)))
    first = fps.select("fp", F.explode(top).alias("mask")).select(
        "fp",
        F.col("fp").bitwiseXOR(F.col("mask")).alias("base"),
        (F.lit(radius) - F.bit_count("mask")).cast("int").alias("left"),
    )
    prefix = F.shiftrightunsigned("base", 64 - PREFIX).cast("long")
    first = first.withColumn("key", prefix + F.col("fp").bitwiseAND((1 << (64 - bits)) - 1) * (1 << PREFIX))
    # At most 2 ** PREFIX prefixes exist for each value of the lower bits, which bounds what is broadcast here.
    hot = first.groupBy("key").count().filter(F.col("count") > hot_rows).select("key", F.lit(True).alias("hot"))
    first = first.join(F.broadcast(hot), "key", "left")
    low = range(64 - 2 * PREFIX, 64 - PREFIX)
    second = F.lit(None).cast("array<long>")
    for left in range(radius + 1):
        second = F.when(F.col("left") == left, F.array(*map(F.lit, flip_masks(low, left)))).otherwise(second)
    rows = first.withColumn("mask", F.explode(F.when(F.col("hot"), second).otherwise(F.array(F.lit(0).cast("long")))))
    base = F.col("base").bitwiseXOR(F.col("mask"))
    sub = F.shiftrightunsigned(base, 64 - 2 * PREFIX).bitwiseAND((1 << PREFIX) - 1).cast("long")
    return rows.select((F.col("key") * (1 << (PREFIX + 1)) + F.when(F.col("hot"), sub + 1).otherwise(0)).alias("key"), "fp")


def _unpacked(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hot, base, left of rows: base is fp with the key's bits on top, below which up to ``left`` bits may be flipped."""
    values, own = key.view(np.uint64), fp.view(np.uint64)
    second = values & np.uint64((1 << (PREFIX + 1)) - 1)  # 0: the first level only; else the next bits and 1
    hot = second > 0
    top = ((values >> np.uint64(PREFIX + 1)) & np.uint64((1 << PREFIX) - 1)) << np.uint64(64 - PREFIX)
    short = top | own & np.uint64((1 << (64 - PREFIX)) - 1)
    long = top | (second - hot.astype(np.uint64)) << np.uint64(64 - 2 * PREFIX) | own & np.uint64((1 << (64 - 2 * PREFIX)) - 1)
    base = np.where(hot, long, short)
    return hot, base.view(np.int64), radius - np.bitwise_count(base ^ own).astype(np.int64)


def _shared_variants(fp: np.ndarray, base: np.ndarray, left: np.ndarray, low: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Write out the variants of the rows, flips at ``low``: those of several fingerprints, sorted, whose they are, and the number of each."""
    variants, owners = [], []
    for flips in np.unique(left):
        rows = np.flatnonzero(left == flips)
        masks = np.array(flip_masks(low, int(flips)), np.int64)
        variants.append((base[rows, None] ^ masks).ravel())
        owners.append(np.repeat(fp[rows], len(masks)))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variant)
    variant, owner = variant[order], owner[order]
    fresh = np.concatenate(([True], variant[1:] != variant[:-1]))
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(variant)))
    member = np.repeat(sizes > 1, sizes)
    return variant[member], owner[member], sizes[sizes > 1]


def meeting_links(fp: np.ndarray, base: np.ndarray, left: np.ndarray, low: range, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Write out the variants of the rows, flips at ``low``, and link the fingerprints of equal ones to the least."""
    _, owner, sizes = _shared_variants(fp, base, left, low)
    if not len(sizes):
        return owner, owner
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    least = np.repeat(np.minimum.reduceat(owner, begins), sizes)
    pairs = np.unique(np.stack([least, owner], axis=1), axis=0)
    a, b = pairs[pairs[:, 0] != pairs[:, 1]].T
    near = np.bitwise_count((a ^ b).view(np.uint64)) <= reach
    return a[near], b[near]


def _links_of(batches: Iterator[pa.RecordBatch], reach: int, rows_at_once: int, bits: int, meet=meeting_links) -> Iterator[pa.RecordBatch]:
    """What ``meet`` makes of a partition sorted by hot and key; whole keys are handled together."""
    held: list[pa.RecordBatch] = []

    def flush(table: pa.Table):
        key, fp = (table[c].to_numpy() for c in ("key", "fp"))
        hot, base, left = _unpacked(key, fp, reach // 2)
        for level, part in enumerate((~hot, hot), 1):
            if part.any():
                a, b = meet(fp[part], base[part], left[part], range(64 - bits, 64 - PREFIX * level), reach)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows, wait = 0, rows_at_once
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= wait:
            table = pa.Table.from_batches(held)
            key = table["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            for first, last in _pieces(key[:cut], rows_at_once):
                yield from flush(table.slice(first, last - first))
            held = table.slice(cut).to_batches()
            rows -= cut
            wait = max(rows_at_once, 2 * rows)  # a long key is not looked through at every batch
    if held:
        table = pa.Table.from_batches(held)
        for first, last in _pieces(table["key"].to_numpy(), rows_at_once):
            yield from flush(table.slice(first, last - first))


def _pieces(key: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` rows that end where a key ends."""
    first = 0
    while first < len(key):
        last = min(first + most, len(key))
        last = int(np.searchsorted(key, key[last - 1], "right"))
        yield first, last
        first = last


def near_links(
    fps: DataFrame, distance: int = 4, hot_rows: int = 100_000, rows_at_once: int = 40_000, bits: int = 64
) -> DataFrame:
    """Distinct links a < b between distinct fingerprints (column fp) that connect all at most ``distance`` bits apart.

    Fingerprints that meet in a variant are linked to the least of them, not to each other: all
    of them are within the distance, so components are those of all links. Only the top ``bits`` (24 at
    least) may differ: values with different lower bits never meet.
    """
    return met_in_balls(fps, distance, hot_rows, rows_at_once, bits, meeting_links).distinct()


def met_in_balls(fps: DataFrame, distance: int, hot_rows: int, rows_at_once: int, bits: int, meet) -> DataFrame:
    """What ``meet`` makes of the fingerprints of each variant, as columns a and b."""
    if distance % 2:
        raise ValueError("the ball has half the distance as its radius, so the distance is even")
    rows = _ball_rows(fps, distance // 2, hot_rows, bits)
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda b: _links_of(b, distance, rows_at_once, bits, meet), "a long, b long")


def row_name() -> Column:
    """A row's name; a group's least name is its first row."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")


def with_firsts(rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """rows with ``first``: the least name that links reach. nodes: node, least (name) and n (number) of its rows."""
    roots = components(links)
    linked = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = materialize(linked, "linked")
    firsts = linked.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("members"))
    named = skew_join(linked, firsts, "root", "members", linked.count(), F.xxhash64("node")).select("node", "n", "first")
    return skew_join(rows, named, "node", "n", rows.count(), F.col("row"))


def simhash_groups(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents are linked when their fingerprints differ in at most ``distance`` bits, and
    component_id is the smallest doc_id that links reach from a document, itself included.

    - Null, empty and blank texts have fingerprint zero and are linked like any other.
    - Equal texts, and texts of equal shingles, share a fingerprint: they are one node.
    - A null doc_id keeps its row; component_id ignores nulls, and is null if there is nothing else.
    - Rows that repeat a doc_id are separate documents of the same name.
    - An empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = materialize(fingerprints(docs, shingle).withColumnRenamed("fp", "node"), "fingerprints")
    nodes = materialize(rows.groupBy("node").agg(F.min(row_name()).alias("least"), F.count("*").alias("n")), "nodes")
    links = materialize(near_links(nodes.select(F.col("node").alias("fp")), distance), "near_links")
    rows = with_firsts(rows, nodes, links)
    printed = F.lower(F.lpad(F.hex("node"), 16, "0"))
    return rows.select("doc_id", printed.alias("fingerprint"), F.col("first.doc_id").alias("component_id"))
