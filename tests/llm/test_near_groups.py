import random
import re

import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import near_groups
from codeloom.llm.common import Scratch
from codeloom.llm.near_groups import _comparable, keep_one_of_group, prefix_rows, shingle_sketches, similar_links
from codeloom.llm.simhash import row_name, shingle_hashes

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def slow_kept(rows, similarity, shingle=5):
    """Ids of the least row of every group of texts linked by the similarity of their shingle sets, by brute force."""
    sets = []
    for _, text in rows:
        words = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            either = len(sets[i] | sets[j])
            if not either or len(sets[i] & sets[j]) >= similarity * either:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (d is None, d or 0))
    return sorted(least.values())


def near_texts(rng, changes, words=300, texts=25):
    """Texts, and copies with so many runs of changed words."""
    rows = []
    for _ in range(texts):
        base = [rng.choice("abcdefgh") + str(rng.randrange(5000)) for _ in range(words)]
        rows.append(" ".join(base))
        for n in changes:
            copy = list(base)
            for at in rng.sample(range(words), n):
                copy[at] = f"changed{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    return rows


def test_groups_by_similarity_against_brute_force(spark):
    rng = random.Random(11)
    texts = near_texts(rng, (1, 4, 8, 20, 40)) + near_texts(rng, [2] * 60, texts=1)  # 60 copies are a dense group
    odd = [None, "", " \n", "one", "One", "a b c d e", "a b c d e f", "same " * 30, "same " * 50, "long text " * 30000]
    rows = list(enumerate(texts + odd)) + [(None, "one"), (3, texts[0]), (None, "no id at all, none"), (0, texts[0])]
    docs = spark.createDataFrame([(i, t, 1, None) for i, t in rows], "doc_id long, text string, root int, node string")
    kept = keep_one_of_group(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert got == slow_kept(rows, 0.8)
    assert keep_one_of_group(docs.limit(0)).count() == 0


def test_most_pairs_at_the_threshold_are_found(spark):
    texts = near_texts(random.Random(5), [6], texts=120)  # similarities a little above 0.8
    rows = list(enumerate(texts))
    want = slow_kept(rows, 0.8)
    got = [(False, r.doc_id) for r in keep_one_of_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert set(want) <= set(got)  # no text goes that should stay
    assert len(got) - len(want) <= 0.1 * (len(rows) - len(want)) and len(want) < 0.8 * len(rows)


def test_all_that_meet_are_compared(spark, monkeypatch):
    """A node in the same key as nearer ones is not lost because the key's leader is a stranger to it."""
    base = [f"w{k}" for k in range(120)]
    copy = [*base[:60], "other", *base[61:]]
    stranger = [f"v{k}" for k in range(120)]
    rows = [(k, " ".join(t)) for k, t in enumerate((stranger, base, copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = shingle_sketches(docs, 5, 10, 80).groupBy("node").agg(F.min(row_name()).alias("least"), F.count("*").alias("n"), F.first("sketch").alias("sketch"), F.first("size").alias("size"), F.first("set").alias("set"))
    ids = {r.least.doc_id: r.node for r in nodes.collect()}
    for leader in range(3):  # all texts meet in one key; whoever leads it, base and copy are linked
        led = nodes.withColumn("n", F.when(F.col("node") == ids[leader], 9).otherwise(F.col("n")))
        met = led.select(F.lit(7).cast("long").alias("key"), "node", "n")
        for few in (0, 8) if leader == 0 else (8,):  # through the prefix index, and pair by pair
            monkeypatch.setattr(near_groups, "FEW", few)
            links = similar_links(docs, led, met, 0.8, 5, Scratch(spark)).collect()
            assert {frozenset((r.a, r.b)) for r in links} == {frozenset((ids[1], ids[2]))}


def test_prefix_lists_hold_all_similar_pairs(spark):
    rng = random.Random(4)
    sets = []
    for _ in range(60):
        base = rng.sample(range(3000), rng.randrange(1, 120))
        for _ in range(6):
            part = rng.sample(base, rng.randrange(max(1, len(base) * 3 // 4), len(base) + 1))
            sets.append(sorted({*part, *rng.sample(range(3000, 9000), rng.randrange(len(base) // 5 + 1))}))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})}
    df = spark.createDataFrame([(k, 1, s) for k, s in enumerate(sets)], "node long, n long, set array<long>")
    rooted = prefix_rows(df, 0.8, Scratch(spark)).withColumn("root", F.col("node")).cache()
    a, b = rooted.alias("a"), rooted.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & _comparable(0.8, "a", "b") & (F.col("a.node") < F.col("b.node")))
    assert want <= {(r.x, r.y) for r in met.select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).collect()}
    assert len(want) > 50


def kept_of(texts):
    """Least ids of the groups that all pairs of the similarity make."""
    sets = [np.unique(shingle_hashes(t.encode(), 5)) for t in texts]
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros((len(sets), len(every)), np.float32)
    has[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), place] = 1
    both, sizes = has @ has.T, has.sum(axis=1)
    near = both >= 0.8 * (sizes[:, None] + sizes[None, :] - both) - 1e-4
    least = np.arange(len(sets))
    while True:
        now = np.where(near, least[None, :], len(sets)).min(axis=1)
        if (now == least).all():
            return sorted(set(least.tolist()))
        least = now


def test_hub_of_many_near_copies(spark):
    """2000 copies near one text, most of them too different from each other."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(2000):
        copy = list(base)
        for at in rng.sample(range(300), rng.choice((5, 6, 7, 8))):
            copy[at] = f"c{k}x{at}"
        texts.append(" ".join(copy))
    texts.append(" ".join(base))
    kept = keep_one_of_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want, got = kept_of(texts), sorted(r.doc_id for r in kept.collect())
    assert set(want) <= set(got) and len(got) <= len(want) + 2


def test_repeated_rows_and_clashing_names(spark):
    names = ("row", "node", "n", "key", "root", "set", "doc", "__bucket", "bitmap", "values")
    rows = [(k // 40, "the same text said again and again", *[f"x{k // 40}"] * len(names)) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = keep_one_of_group(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [rows[0]]


def test_pairs_of_short_texts_are_all_found(spark):
    rng = random.Random(9)
    texts = []
    for words, less in [(9, 1)] * 150 + [(19, 3)] * 50 + [(68, 12)] * 20 + [(84, 16)] * 20:  # similarities of 0.8 and a little above
        text = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        texts += [" ".join(text), " ".join(text[:-less])]
    rows = list(enumerate(texts))
    want = slow_kept(rows, 0.8)
    got = [(False, r.doc_id) for r in keep_one_of_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == want and len(want) == len(rows) // 2
