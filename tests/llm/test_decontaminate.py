import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloom.llm import decontaminate
from codeloom.llm.common import Scratch
from codeloom.llm.decontaminate import clean_documents, contaminated, near_items


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(words, size):
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def slow_leaks(docs, items):
    """(doc_id, item_id) with the best similarity of any window of the item's number of words, by brute force."""
    found = {}
    for item_id, item in items:
        own = words_of(item)
        if not own:
            continue
        size = min(5, len(own))
        bag = shingles(own, size)
        for doc_id, text in docs:
            said = words_of(text)
            for start in range(max(1, len(said) - len(own) + 1)):
                window = shingles(said[start : start + len(own)], size)
                either = sum((bag | window).values())
                value = sum((bag & window).values()) / either if either else 0
                if value >= 0.8 - 1e-12:
                    found[doc_id, item_id] = max(value, found.get((doc_id, item_id), 0))
    return found


def planted(rng, texts=60):
    """Items of several lengths, and documents with items in which words are changed or that are cut."""
    items = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice((3, 12, 20, 21, 40, 80))))) for k in range(20)]
    docs = []
    for k in range(texts):
        body = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 200))]
        if k % 2:
            part = items[rng.randrange(20)][1].split()
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = "changed"
            if rng.random() < 0.3:
                part = part[: len(part) - rng.randrange(3)]
            body = body[:40] + part + body[40:] if rng.random() < 0.8 else part
        docs.append((k, " ".join(body)))
    return docs, items


@pytest.fixture
def tables(spark):
    docs, items = planted(random.Random(2))
    docs += [(100, items[0][1]), (101, items[0][1]), (102, None), (103, ""), (104, "... !")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_leaks_against_brute_force(tables, monkeypatch, broadcast_rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast_rows)
    docs, items, d, b = tables
    want = slow_leaks(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(d, b).collect()}
    assert len(want) > 12 and set(got) <= set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got) and len(got) >= 0.98 * len(want)


def test_results_come_through_the_index(tables, monkeypatch):
    _, _, d, b = tables
    monkeypatch.setattr(decontaminate, "block_index", lambda items, radius, blocks, f=decontaminate.block_index: f(items, radius, blocks).limit(0))
    assert contaminated(d, b).count() == 0
    assert clean_documents(d, b).count() == d.count()


def test_index_finds_all_within_the_radius(spark):
    rng = random.Random(8)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = [rng.getrandbits(64) for _ in range(15)]
    windows = []
    for k in range(400):
        x = fps[k % 15]
        for bit in rng.sample(range(64), rng.randrange(25)):
            x ^= 1 << bit
        windows.append((k, 9 if k % 20 else 8, x))
    items = spark.createDataFrame([(k, 9, signed(x)) for k, x in enumerate(fps)], "item long, n_words int, fp long")
    rows = spark.createDataFrame([(k, n, signed(x)) for k, n, x in windows], "content long, n_words int, own_fp long")
    got = sorted((r.content, r.item, r.hamming) for r in near_items(rows, items, 19, 5, Scratch(spark)).collect())
    want = sorted((k, i, (x ^ y).bit_count()) for k, n, x in windows for i, y in enumerate(fps) if n == 9 and (x ^ y).bit_count() <= 19)
    assert got == want and len(want) > 100


def test_recall_at_the_similarity(spark):
    """Windows of a similarity of 0.8 and little more, which lie farthest from their items."""
    rng = random.Random(6)
    items, docs = [], []
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((26, 49)))]
        items.append((k, " ".join(words)))
        n = len(words) - 4
        words[-(n - -(-n * 8 // 9)) :] = ["changed"] * (n - -(-n * 8 // 9))
        docs.append((k, " ".join(words)))
    want = slow_leaks(docs, items)
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert len(want) == 150 and got.count() >= 0.98 * len(want)


def test_clashing_names_and_repeats_stay(spark, tables):
    _, items, _, b = tables
    names = ("__doc", "row", "doc", "bitmap", "__bit", "__salt", "n", "named")
    rows = [(k, t, *[f"x{k}"] * len(names)) for k, t in [(1, "clean text"), (1, "clean text"), (2, items[3][1]), (2, items[3][1]), (None, None)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = clean_documents(docs, b)
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[0], rows[1], rows[4]]))
    everything = clean_documents(docs.withColumn("more", F.lit(1)), b.limit(0))
    assert everything.count() == 5
