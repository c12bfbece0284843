"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

Documents and items are sequences of words (runs of letters and digits, lower case) and of hashed
word shingles. Windows of an item's number of words are fingerprinted and looked up in a multi-index of all items'
fingerprints: these are cut into blocks of bits, and every item stands under each value of a block that differs from its own in at most
radius / blocks bits. Two fingerprints within the radius agree with one of these values in some block, so the
index finds all of them. What it finds is verified by the weighted Jaccard similarity of the
shingles, each weighted by how often it occurs.

Windows that cannot reach the similarity t with any item are not fingerprinted: of an item's n shingles at least t * n must be in
the window, so a window goes that holds fewer shingles of all items of this number of words together. Which items these may be is
not told to the index. Windows of equal shingles are one entry, however many documents hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, hash_filter, keep_rows, materialize, passes, skew_join, with_filter

BITS = 64
LANE = 127  # what a counter may reach
#: Up to so many distinct shingles of items, and rows of their index, are broadcast; beyond, joins are shuffled and hot keys salted.
BROADCAST_ROWS = 200_000


def words(text: str) -> Column:
    """Runs of letters and digits in lower case; empty for null."""
    parts = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", -1)
    return F.array_remove(parts, "")


def shingle_hashes(word: str, size: int) -> Column:
    """Hashes of each run of ``size`` words; empty if there are fewer."""
    count = F.size(word) - (size - 1)
    at = lambda i: F.xxhash64(*[F.get(word, i + k) for k in range(size)])
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(F.array().cast("array<long>"))


def simhash(hashes: str) -> Column:
    """The SimHash of an array of hashes: a bit is set that is set in over half of them."""
    zero = F.transform(F.sequence(F.lit(0), F.lit(BITS // 8 - 1)), lambda _: F.lit(0).cast("long"))
    lanes = 0x0101010101010101
    # Eight byte-wide counters to a long; arrays are taken LANE at a time, so that the signed long never overflows.
    size = F.size(hashes)
    piece = lambda n: F.aggregate(
        F.slice(hashes, n * LANE + 1, F.lit(LANE)),
        zero,
        lambda acc, h: F.transform(acc, lambda a, i: a + F.call_function("shiftrightunsigned", h, i).bitwiseAND(lanes)),
    )
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(size / LANE).cast("int") - 1, F.lit(0))), piece)

    def bit(b: Column, counted: Column) -> Column:
        lane, shift = b % 8, F.floor(b / 8).cast("int") * 8
        counts = F.transform(counted, lambda p: F.call_function("shiftrightunsigned", F.get(p, lane), shift).bitwiseAND(255))
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
        return F.when(total * 2 > size, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    zero_bits = F.lit(0).cast("long")
    positions = F.sequence(F.lit(0), F.lit(BITS - 1))
    # An array of one binds the counters, which are then computed once and not for every bit.
    bound = F.transform(F.array(pieces), lambda counted: F.aggregate(positions, zero_bits, lambda a, b: a.bitwiseXOR(bit(b, counted))))
    return F.get(bound, F.lit(0))


def _edges(blocks: int) -> list[tuple[int, int]]:
    """First bit and end of each of ``blocks`` runs of bits that make up a fingerprint."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _block(fp: Column, first: int, end: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND((1 << (end - first)) - 1 if end - first < BITS else -1)


def _flips(width: int, most: int) -> Column:
    """All values of ``width`` bits with at most ``most`` of them set."""
    every = F.sequence(F.lit(0).cast("long"), F.lit((1 << width) - 1).cast("long"))
    return F.filter(every, lambda x: F.bit_count(x) <= most)


def block_index(items: DataFrame, radius: int, blocks: int) -> DataFrame:
    """item, fp, n_words and key (number of words, block, value) of every value of a block within radius // blocks bits of the item's."""
    parts = None
    for k, (first, end) in enumerate(_edges(blocks)):
        value = _block(F.col("fp"), first, end).bitwiseXOR(F.col("flip"))
        rows = items.select("item", "fp", "n_words", F.explode(_flips(end - first, radius // blocks)).alias("flip"))
        rows = rows.select("item", "fp", F.xxhash64("n_words", F.lit(k), value).alias("key"), F.lit(k).alias("block"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def near_items(windows: DataFrame, items: DataFrame, radius: int, blocks: int, scratch: Scratch) -> DataFrame:
    """content, item and hamming of all windows (content, n_words, own_fp) and items (item, n_words, fp) of as many words
    whose fingerprints differ in at most ``radius`` bits."""
    index = scratch.write(block_index(items, radius, blocks), "index")
    keys = F.array(*[F.xxhash64("n_words", F.lit(k), _block(F.col("own_fp"), *e)) for k, e in enumerate(_edges(blocks))])
    rows = windows.select("content", "own_fp", F.explode(keys).alias("key"))
    differ = F.col("fp").bitwiseXOR(F.col("own_fp"))
    # A pair meets in every block that is near enough; the first of them counts.
    meets = [F.when(F.bit_count(_block(differ, *e)) <= radius // blocks, F.lit(k)) for k, e in enumerate(_edges(blocks))]
    near = (F.bit_count(differ) <= radius) & (F.coalesce(*meets) == F.col("block"))
    if index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    rows, index = rows.alias("w"), index.alias("i")
    met = rows.join(index, (F.col("w.key") == F.col("i.key")) & near)
    return met.select("content", "item", F.bit_count(differ).cast("int").alias("hamming"))


def _shingled(word: str, n_words: Column, shingle: int) -> Column:
    """Hashes of the shingles of words: of ``shingle`` of them, or of all where the item has fewer."""
    hashes = F.lit(None).cast("array<long>")
    for k in range(1, shingle + 1):
        hashes = F.when(F.least(n_words, F.lit(shingle)) == k, shingle_hashes(word, k)).otherwise(hashes)
    return hashes


def benchmark_items(benchmark: DataFrame, shingle: int = 5) -> DataFrame:
    """item (hash of id and shingles), item_id, n_words, hashes and fp of each item text with words."""
    kept = benchmark.select("item_id", words("text").alias("word")).filter(F.size("word") > 0)
    items = kept.withColumn("n_words", F.size("word"))
    items = items.withColumn("hashes", _shingled("word", F.col("n_words"), shingle)).select("item_id", "n_words", "hashes", simhash("hashes").alias("fp"))
    return items.withColumn("item", F.xxhash64("item_id", "n_words", "hashes")).dropDuplicates(["item"])


def _promising(keyed: DataFrame, items: DataFrame, similarity: float, shingle: int, scratch: Scratch) -> DataFrame:
    """doc, doc_id, n_words, start: windows of an item's number of words with enough shingles of items of that number."""
    size = F.least("n_words", F.lit(shingle))
    each = items.select("n_words", size.alias("size"), F.explode("hashes").alias("hash"))
    lookup = scratch.write(each.groupBy("hash", "size").agg(F.collect_set("n_words").alias("lengths")), "item_shingles")
    sizes = sorted(r[0] for r in lookup.select("size").distinct().collect())  # at most ``shingle`` values
    small = lookup.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = None
    for k in sizes:
        places = keyed.select("doc_id", "doc", F.posexplode(shingle_hashes("word", k)).alias("at", "hash"))
        own = lookup.filter(F.col("size") == k).select("hash", "lengths")
        if small:
            hits = places.join(F.broadcast(own), "hash")
        else:
            places = with_filter(places, F.col("hash"), hash_filter(own, F.col("hash"))).filter(passes())
            places = scratch.write(places.select("doc_id", "doc", "at", "hash"), "places")
            counted = places.groupBy("hash").agg(F.count("*").alias("places")).join(own, "hash")
            hits = skew_join(places, scratch.write(counted, "counted"), "hash", "places", places.count(), F.xxhash64("doc", "at"))
        hits = hits.select("doc_id", "doc", "at", F.explode("lengths").alias("n_words"))
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("doc", "n_words").agg(F.min("doc_id").alias("doc_id"), F.collect_set("at").alias("hits"))
    n = F.col("n_words") - size + 1
    found = found.withColumns({"n": n, "needed": F.ceil(n * F.lit(similarity) - 1e-9).cast("int")})
    found = found.filter(F.size("hits") >= F.col("needed")).withColumn("hits", F.array_sort("hits"))
    # Starts of windows of n shingles that hold the needed number of hits: from the place of a hit i + needed - 1
    # less n - 1 up to that of hit i.
    runs = F.transform(
        F.sequence(F.lit(0), F.size("hits") - F.col("needed")),
        lambda i: F.struct(
            F.greatest(F.get("hits", i + F.col("needed") - 1) - F.col("n") + 1, F.lit(0)).alias("first"),
            F.get("hits", i).alias("last"),
        ),
    )
    starts = F.flatten(F.transform(F.filter(runs, lambda r: r["first"] <= r["last"]), lambda r: F.sequence(r["first"], r["last"])))
    return found.select("doc", "doc_id", "n_words", F.explode(F.array_distinct(starts)).alias("start"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 19, blocks: int = 5
) -> DataFrame:
    """One row per document and benchmark item with a window of the item in it:
    doc_id, item_id, start_word, n_words, similarity, hamming (of the most similar, first window).

    The index finds every fingerprint within ``radius`` bits. At a similarity of exactly 0.8 some 9.7 bits differ on
    average, with a standard deviation of 2.9, so a radius of 19 is missed by about one such pair in a thousand.

    - Items of fewer than ``shingle`` words are one shingle of all their words.
    - A document shorter than the item is one window as a whole.
    - Null and wordless texts and items match nothing; a null doc_id or item_id is kept as such.
    - Rows that repeat a doc_id give one row for each item that any of them holds.
    - Empty tables give no rows; other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    items = scratch.write(benchmark_items(benchmark, shingle), "items")
    if items.isEmpty():
        scratch.clear()
        none = "doc_id long, item_id long, start_word int, n_words int, similarity double, hamming int"
        return docs.sparkSession.createDataFrame([], none)
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), words("text").alias("word"))
    windows = scratch.write(_promising(keyed, items, similarity, shingle, scratch), "windows")

    # The windows' own shingles: documents with windows are read again, others are not needed.
    texts = with_filter(keyed, F.col("doc"), hash_filter(windows, F.col("doc"))).filter(passes())
    spans = windows.join(texts.select("doc", "word").dropDuplicates(["doc"]), "doc")
    # A window is moved back into the document, and is the whole document where that is shorter than the item.
    last = F.greatest(F.size("word") - F.col("n_words"), F.lit(0))
    spans = spans.withColumn("start", F.least("start", last)).withColumn("piece", F.slice("word", F.col("start") + 1, F.col("n_words")))
    spans = spans.select("doc_id", "n_words", "start", _shingled("piece", F.col("n_words"), shingle).alias("own"))
    spans = scratch.write(spans.withColumn("content", F.xxhash64("n_words", "own")), "spans")
    contents = spans.groupBy("content").agg(F.first("n_words").alias("n_words"), F.first("own").alias("own"), F.count("*").alias("copies"))
    # Written, or predicates on the fingerprint would be pushed below it and compute it again.
    contents = scratch.write(scratch.write(contents, "contents").withColumn("own_fp", simhash("own")), "fingerprints")

    met = near_items(contents, items, radius, blocks, scratch)
    rows = items.select("item", "item_id", "hashes")
    scored = met.join(contents.select("content", "own", "copies"), "content").join(rows, "item")
    scored = scored.withColumn("similarity", weighted_jaccard("own", "hashes")).filter(F.col("similarity") >= similarity)
    told = F.collect_list(F.struct("item_id", "similarity", "hamming")).alias("told")
    scored = scratch.write(scored.groupBy("content").agg(told, F.first("copies").alias("copies")), "scored")
    places = skew_join(spans.drop("own"), scored, "content", "copies", spans.count(), F.xxhash64("doc_id", "start"))
    places = places.select("doc_id", "start", "n_words", F.explode("told").alias("t"))
    best = F.min(F.struct((-F.col("t.similarity")).alias("s"), "start", "n_words", "t.hamming")).alias("best")
    out = places.groupBy("doc_id", "t.item_id").agg(best).select(
        "doc_id", "item_id", F.col("best.start").alias("start_word"), F.col("best.n_words").alias("n_words"),
        (-F.col("best.s")).alias("similarity"), F.col("best.hamming").alias("hamming"),
    )
    out = materialize(out, "contaminated")
    scratch.clear()
    return out


def weighted_jaccard(a: str, b: str) -> Column:
    """Sum of least over sum of greatest multiplicities of the values of two arrays."""
    times = lambda array, x: F.size(F.filter(array, lambda y: y == x))
    both = F.aggregate(
        F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x))
    )
    return both / (F.size(a) + F.size(b) - both)


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, without those that hold a benchmark item.

    Rows are told apart by a hash of doc_id and text, so a null doc_id is judged by its own text,
    and repeated rows go or stay together. Null and wordless texts stay. Empty tables give no rows, or take none away.
    Other columns are kept, whatever their names.
    """
    leaks = contaminated(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), benchmark, **how)
    return keep_rows(docs, leaks.select(F.col("doc_id").alias("row")).distinct(), named=False)
