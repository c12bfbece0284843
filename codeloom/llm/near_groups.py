"""Groups of near-duplicates by verified similarity, found by ball hashing.

One SimHash of 64 bits misses most pairs of a shingle similarity near 0.8. Texts therefore meet by several
shorter fingerprints of independent hashes, each with its ball of variants. What meets is a candidate and is told as memberships (key, node),
one for each node and table at most, never as the pairs of a large key. Every node is compared with one that it meets; that joins most of a group. Of keys with few nodes
the pairs of different components are compared then. Larger keys that still
hold several components are open. Their nodes, and all sets of few shingles, whose bits do not follow the angle, are
compared through a prefix index:

- A shingle that no other of these nodes has is shared with none of them. What a node shares at most is known from the rest,
  so a copy of which too much was changed lies in few lists or in none.
- Lists are kept for each pair of size classes, and a pair is compared only where the shingles from here on suffice.
- The most central node of each list (fewest shingles of its own) is compared with all of its list and leaves it, again
  and again, until the pairs of different components that are left are few for each node or stay as many; then all of these
  are compared that the bounds let pass.

Before sets are fetched, pairs go whose fingerprints differ in so many bits of all tables as only strangers' do.
Links are verified by the exact Jaccard similarity of whole sets of 64-bit shingle hashes. A node is such a set, named by
a 64-bit hash of it: two different sets have the same name with a chance of 2 ** -64.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, hash_filter, materialize, passes, rows_of, skew_join, with_filter
from codeloom.llm.components import components
from codeloom.llm.simhash import SEED, majority_bits, meeting_links, met_in_balls, named_texts, remixed, row_name, shingle_hashes

SMALL = 64  # sets of at most so many shingles are found by shared shingles
FEW = 8  # nodes of a key whose pairs are told
RATIO = 1.1  # of the sizes of a size class
SLACK = 1e-9  # against rounding of bounds on whole numbers


def shingle_sketches(docs: DataFrame, shingle: int, rows: int, small: int) -> DataFrame:
    """doc_id, row, node (hash of the set of shingles), size (of the set), sketch (64-bit fingerprints of so many
    independent hashes) and set (the hashes, of sets up to ``small``; else null)."""

    def run(batches):
        for batch in batches:
            sketches = np.zeros((batch.num_rows, rows), np.uint64)
            nodes, sizes, sets = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int32), []
            for k, text in enumerate(batch["text"].to_pylist()):
                hashes = np.unique(shingle_hashes(text, shingle))
                nodes[k], sizes[k] = xxhash.xxh64_intdigest(hashes.tobytes(), SEED), len(hashes)
                if len(hashes):
                    sketches[k] = majority_bits(remixed(hashes, rows))
                sets.append(hashes.view(np.int64) if len(hashes) <= small else None)
            columns = [
                batch["doc_id"],
                batch["row"],
                pa.array(nodes.view(np.int64)),
                pa.array(sizes),
                pa.ListArray.from_arrays(np.arange(0, sketches.size + 1, rows, dtype=np.int32), pa.array(sketches.view(np.int64).ravel())),
                pa.array(sets, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "node", "size", "sketch", "set"])

    schema = "doc_id long, row long, node long, size int, sketch array<long>, set array<long>"
    return named_texts(docs).mapInArrow(run, schema)


def sets_of(docs: DataFrame, chosen: DataFrame, shingle: int) -> DataFrame:
    """node and set (distinct shingle hashes) of chosen rows: node and row, one row a node; other texts are not moved."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle)) for t in batch["text"].to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["node"], pa.ListArray.from_arrays(ends, pa.array(flat))], ["node", "set"])

    row = F.col("row")
    texts = with_filter(named_texts(docs).select("row", "text"), row, hash_filter(chosen, row)).filter(passes())
    texts = texts.groupBy("row").agg(F.first("text").alias("text"))  # rows that repeat meet no later than here
    return texts.join(chosen, "row").select("node", "text").mapInArrow(run, "node long, set array<long>")


def _meetings(nodes: DataFrame, bits: int, tables: int, distance: int, scratch: Scratch) -> DataFrame:
    """key, node and n: nodes that meet by the top ``bits`` of a fingerprint in some table are under one key.

    A key stands for all values of a table that meetings join, so a node has one key a table at most, however dense its group.
    """
    # The table's number takes the place of the lower bits, so that tables never meet and one pass does for all.
    of_hash = 64 // bits
    cut = lambda t: F.shiftleft(F.shiftrightunsigned(F.get("sketch", F.lit(t // of_hash)), t % of_hash * bits), 64 - bits).bitwiseOR(t)
    each = nodes.select("node", "n", F.explode(F.array(*map(cut, range(tables)))).alias("fp"))
    values = scratch.write(each.groupBy("fp").agg(F.count("*").alias("nodes")), "values")
    links = scratch.write(met_in_balls(values.select("fp"), distance, 100_000, 40_000, bits, meeting_links).distinct(), "value_links")
    clusters = components(links, write=scratch.write).withColumnRenamed("node", "fp")
    key = F.coalesce("root", F.when(F.col("nodes") > 1, F.col("fp")))  # a value that meets no other is met by its own nodes
    keyed = values.join(clusters, "fp", "left").select("fp", "nodes", key.alias("key")).filter("key IS NOT NULL")
    met = skew_join(each, scratch.write(keyed, "keyed"), "fp", "nodes", tables * rows_of(nodes), F.col("node"))
    return met.select("key", "node", "n")


def _needed(similarity: float, a: Column, b: Column) -> Column:
    """How many shingles sets of these sizes share at least where they have the similarity."""
    return F.ceil((a + b) * F.lit(similarity / (1 + similarity)) - SLACK)


def prefix_rows(sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """key, node, n, side, cross, size, left, central: lists in which each two of the similarity meet, as told below.

    With shingles in one order for all, two sets that share k shingles share one of the first size - k + 1 of either. Rare
    shingles come first, and those of one set only meet nothing. A list is of a shingle and two size classes; where these
    differ (cross), nodes of different sides are to be compared. ``left`` shingles of the set are not before this one;
    ``central`` is the part of its shingles that the set shares.
    """
    each = sets.select("node", "n", F.size("set").alias("size"), F.explode("set").alias("shingle"))
    found = scratch.write(each.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1"), "shingles")
    ranked = skew_join(each, found, "shingle", "df", sets.agg(F.sum(F.size("set"))).first()[0] or 0, F.col("node"))
    shared = ranked.groupBy("node").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    size, own = F.col("size"), F.size("shared")
    grade = lambda x: F.floor(F.log(x.cast("double")) / math.log(RATIO) + SLACK).cast("int")
    least, most = F.ceil(size * similarity - SLACK), F.floor(size / similarity + SLACK)
    graded = shared.withColumns({"own": grade(size), "other": F.explode(F.sequence(grade(least), grade(most)))})
    smallest = F.greatest(F.ceil(F.pow(F.lit(RATIO), "other") * (1 - 1e-6)), least)
    first = size - _needed(similarity, size, smallest) + 1 - (size - own)
    placed = graded.filter(first > 0).select("node", "n", "size", "own", "other", (own / size).alias("central"), F.size("shared").alias("shares"), F.posexplode(F.slice("shared", F.lit(1), first.cast("int"))).alias("at", "s"))
    return placed.select(
        F.xxhash64("s.shingle", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "n",
        (F.col("own") > F.col("other")).alias("side"), (F.col("own") != F.col("other")).alias("cross"),
        "size", (F.col("shares") - F.col("at")).alias("left"), "central",
    )


def _pruned(lists: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Memberships whose ``left`` suffices for the smallest set that they may be compared with in their list."""
    lists = scratch.write(lists, "all_lists")
    here, there = F.min(F.when(~F.col("side"), F.col("size"))), F.min(F.when(F.col("side"), F.col("size")))
    keys = lists.groupBy("key").agg(F.count("*").alias("m"), here.alias("here"), there.alias("there")).filter("m > 1")
    joined = skew_join(lists, scratch.write(keys, "list_sizes"), "key", "m", rows_of(lists), F.col("node"))
    smallest = F.when(F.col("cross") & ~F.col("side"), F.col("there")).otherwise(F.col("here"))
    return joined.filter(F.col("left") >= _needed(similarity, F.col("size"), smallest)).drop("m", "here", "there")


def _attached(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """pairs with the value of both ends, as value_a and value_b; ends of many pairs are salted."""
    total, met = rows_of(pairs), pairs
    for end, other in ("ab", "ba"):
        counts = pairs.groupBy(end).agg(F.count("*").alias(f"n_{end}"))
        side = counts.join(table.select(F.col("node").alias(end), F.col(value).alias(f"{value}_{end}")), end)
        met = skew_join(met, side, end, f"n_{end}", total, F.xxhash64(other)).drop(f"n_{end}")
    return met


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least this Jaccard similarity."""
    met = _attached(pairs, sets, "set")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return met.filter(both >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - both) - SLACK).select("a", "b")


def _pairs(met: DataFrame, a: str, b: str) -> DataFrame:
    return met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _first_pairs(met: DataFrame, scratch: Scratch) -> DataFrame:
    """At most one pair a node: with that leader of its keys (most rows, then least) which it shares most keys with."""
    order = F.struct("n", F.bitwise_not("node"))
    leaders = met.groupBy("key").agg(F.max_by(F.struct("node", "n"), order).alias("leader"), F.first("m").alias("m"))
    led = skew_join(met.drop("n", "m"), scratch.write(leaders, "leaders"), "key", "m", rows_of(met), F.col("node")).filter("node <> leader.node")
    votes = led.groupBy("node", "leader").agg(F.count("*").alias("shared"))
    best = votes.groupBy("node").agg(F.max_by("leader.node", F.struct("shared", "leader.n", "leader.node")).alias("leader"))
    return _pairs(best, "node", "leader")


def _few_pairs(met: DataFrame, rooted: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs of different components of keys with few nodes, without pairs of two members of the prefix index."""
    told = rooted.select("node", "root").join(members.select("node", F.lit(True).alias("member")), "node", "left")
    listed = F.collect_list(F.struct("node", "root", F.col("member").isNotNull().alias("member"))).alias("nodes")
    keys = met.filter(F.col("m") <= FEW).select("key", "node").join(told, "node").groupBy("key").agg(listed)
    pairs = keys.select("nodes", F.explode("nodes").alias("a")).select("a", F.explode("nodes").alias("b"))
    pairs = pairs.filter("a.node < b.node AND a.root <> b.root AND NOT (a.member AND b.member)")
    return pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def _sieved(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs without those of strangers, told by the bits of all tables.

    A bit of two large sets differs with a chance of their angle over pi, one of strangers with 1/2. The cut is halfway between
    the chances at the similarity and at strangers: ten and more standard deviations from either. Small sets may
    differ in more bits, so pairs of two of them all stay.
    """
    chance = math.acos(2 * similarity / (1 + similarity)) / math.pi
    differ = F.aggregate(
        F.zip_with("sketch_a.sketch", "sketch_b.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x
    )
    few = F.lit(math.floor(SMALL / similarity + SLACK))
    small = (F.col("sketch_a.size") <= few) & (F.col("sketch_b.size") <= few)
    told = _attached(pairs, nodes.select("node", F.struct("sketch", "size").alias("sketch")), "sketch")
    return told.filter(small | (differ <= F.size("sketch_a.sketch") * (64 * (chance + 0.5) / 2))).select("a", "b")


def _rooted(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """nodes with the root of the component that links make."""
    roots = components(links, write=scratch.write)
    return scratch.write(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")


def _open(met: DataFrame, rooted: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Memberships of keys that hold pairs of different components, with the key's number of nodes (m) and greatest
    component (main); and the number of such pairs, told once for each key."""
    met = scratch.write(met.join(rooted.select("node", "root"), "node"), "met")
    here, there = F.count_if(~F.col("side")), F.count_if("side")
    each = met.groupBy("key", "root").agg(here.alias("x"), there.alias("y"), F.first("cross").alias("cross"))
    total = lambda c: F.sum(c.cast("double"))
    x, y = F.col("x"), F.col("y")
    pairs = F.when(F.first("cross"), total(x) * total(y) - total(x * y)).otherwise((total(x) * total(x) - total(x * x)) / 2)
    keys = each.groupBy("key").agg(pairs.alias("pairs"), F.sum(x + y).alias("m"), F.max_by("root", F.struct(x + y, "root")).alias("main"))
    keys = scratch.write(keys.filter("pairs > 0"), "open_keys")
    opened = skew_join(met, keys.drop("pairs"), "key", "m", rows_of(met), F.col("node"))
    return scratch.write(opened, "opened"), int(keys.agg(F.sum("pairs")).first()[0] or 0)


def _comparable(similarity: float, a: str, b: str) -> Column:
    """Whether members of a list (columns a.*, b.*) are in different components and can have the similarity."""
    c = lambda name: (F.col(f"{a}.{name}"), F.col(f"{b}.{name}"))
    (root, root_b), (side, side_b), (size, size_b), (left, left_b) = c("root"), c("side"), c("size"), c("left")
    return (root != root_b) & (~F.col(f"{a}.cross") | (side != side_b)) & (F.least(left, left_b) >= _needed(similarity, size, size_b))


def similar_links(
    docs: DataFrame, nodes: DataFrame, met: DataFrame, similarity: float, shingle: int, scratch: Scratch, at_once: int = 8
) -> DataFrame:
    """Verified links that connect the nodes as all pairs that meet (key, node, n) and have the similarity would."""
    counts = scratch.write(met.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "key_sizes")
    met = scratch.write(skew_join(met, counts, "key", "m", rows_of(met), F.col("node")), "met_of_keys")
    places = nodes.filter("set IS NULL").select("node", F.col("least.row").alias("row"))
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    tried = scratch.write(_first_pairs(met, scratch), "first_pairs")
    near = scratch.write(_sieved(tried, nodes, similarity), "first_near")
    chosen = scratch.write(places.join(ends(near), "node"), "chosen")
    small = nodes.filter("set IS NOT NULL")
    sets = small.select("node", "set").unionByName(scratch.write(sets_of(docs, chosen, shingle), "sets"))
    links = scratch.write(verified(near, sets, similarity), "links")

    rooted = _rooted(met.select("node").distinct(), links, scratch)
    whole = met.filter(F.col("m") > FEW).select("key", "node", F.lit(False).alias("side"), F.lit(False).alias("cross"))
    opened, _ = _open(whole, rooted, scratch)
    members = opened.select("node").unionByName(small.filter("size > 0").select("node")).distinct()
    members = scratch.write(members.join(nodes.select("node", "n"), "node"), "members")
    fresh = scratch.write(_few_pairs(met, rooted, members).join(tried, ["a", "b"], "left_anti"), "few_pairs")
    near = scratch.write(_sieved(fresh, nodes, similarity), "few_near")
    more = ends(near).unionByName(members.select("node")).distinct().join(chosen, "node", "left_anti")
    sets = sets.unionByName(scratch.write(sets_of(docs, scratch.write(places.join(more, "node"), "more"), shingle), "more_sets"))
    links = links.unionByName(scratch.write(verified(near, sets, similarity), "few_links"))
    tried = tried.unionByName(fresh)
    number = rows_of(members)
    lists = _pruned(prefix_rows(members.join(sets, "node"), similarity, scratch), similarity, scratch)
    lists = scratch.write(lists, "lists")
    turn, before = 0, math.inf
    while True:
        rooted = _rooted(members.select("node"), links, scratch)
        opened, left = _open(lists, rooted, scratch)
        if not left:
            return links
        last = left <= at_once * number or left > 0.75 * before  # few pairs, or leaders that join too little
        before = left
        if last:
            few = opened.filter("root <> main").alias("b")
            a = opened.alias("a")
            fresh = a.join(few, (F.col("a.key") == F.col("b.key")) & _comparable(similarity, "a", "b"))
            fresh = fresh.select(F.col("a.node").alias("node"), F.col("b.node").alias("other"))
        else:
            turn += 1
            order = F.struct("central", F.xxhash64("node", F.lit(turn)), "node")
            leader = F.struct("node", "root", "side", "cross", "size", "left")
            leaders = opened.groupBy("key").agg(F.max_by(leader, order).alias("b"), F.count("*").alias("m"))
            rows = opened.select("key", F.struct("node", "n", "root", "side", "cross", "size", "left", "central").alias("a"))
            led = skew_join(rows, scratch.write(leaders, "leaders"), "key", "m", rows_of(opened), F.col("a.node"))
            led = scratch.write(led.filter("a.node <> b.node"), "led")
            lists = led.select("key", "a.node", "a.n", "a.side", "a.cross", "a.size", "a.left", "a.central")
            fresh = led.filter(_comparable(similarity, "a", "b")).select(F.col("a.node").alias("node"), F.col("b.node").alias("other"))
        fresh = scratch.write(_pairs(fresh, "node", "other").join(tried, ["a", "b"], "left_anti"), "fresh")
        found = scratch.write(verified(fresh, sets, similarity), "found")
        links, tried = links.unionByName(found), tried.unionByName(fresh)
        if last:
            return links


def keep_one_of_group(
    docs: DataFrame, similarity: float = 0.8, shingle: int = 5, distance: int = 2, bits: int = 30, tables: int = 20
) -> DataFrame:
    """Rows of docs, all columns: of each group of near-duplicates the one of smallest doc_id.

    Texts are linked whose sets of word shingles have at least this Jaccard similarity; links reach on
    from text to text. Linked texts are found where ``bits`` of their fingerprints differ in at most
    ``distance`` in any of ``tables`` tables: by chance 96 of 100 pairs at a similarity of 0.8, 99.6 at 0.85. Sets of
    up to SMALL shingles and those near them are found by shared shingles as well, without exception. Strangers
    meet by chance, too: beyond some two million distinct texts 30 bits join most values of a table, and nearly all texts go through the
    prefix index; more bits and more tables keep them apart.

    - Null, empty and blank texts have no shingles; they are copies of each other and of nothing else.
    - Texts of fewer words than a shingle are one shingle of all their words.
    - A null doc_id comes after all others; rows that repeat doc_id and text stay once.
    - An empty table gives no rows; other columns are kept, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    small = math.floor(SMALL / similarity + SLACK)
    rows = scratch.write(shingle_sketches(docs, shingle, -(-tables // (64 // bits)), small), "sketches")
    first = [F.first(c).alias(c) for c in ("sketch", "size", "set")]
    nodes = scratch.write(rows.groupBy("node").agg(F.min(row_name()).alias("least"), F.count("*").alias("n"), *first), "nodes")
    met = scratch.write(_meetings(nodes, bits, tables, distance, scratch), "meetings")
    links = similar_links(docs, nodes, met, similarity, shingle, scratch)
    rooted = nodes.select("node", "least").join(components(links, write=scratch.write), "node", "left")
    firsts = rooted.groupBy(F.coalesce("root", "node")).agg(F.min("least").alias("first"))
    kept = materialize(firsts.select("first.row").distinct(), "kept")
    scratch.clear()
    # Rows that repeat are one before they meet in a task.
    named = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.struct("*").alias("doc"))
    return named.groupBy("row").agg(F.first("doc").alias("doc")).join(kept, "row", "left_semi").select("doc.*")
