import random
import re

import numpy as np
import pytest
import xxhash

from codeloom.llm import components as components_module
from codeloom.llm.components import components, joined
from codeloom.llm.simhash import bit_counts, fingerprint, near_links, simhash_groups

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = SPACE.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(nodes, distance):
    """Smallest reachable doc_id by brute force; nodes: (doc_id, fingerprint)."""
    parent = list(range(len(nodes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if (nodes[i][1] ^ nodes[j][1]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(nodes):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(nodes))]


TEXTS = [None, "", "  \n", "one", "One", "a b", "x " * 300, "É é", "a b c", "The cat sat on the mat\tagain\x0bthen\x1cleft", "same same same same same"]


def test_fingerprint_against_slow_one():
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 900))) for _ in range(20)]
    for t in texts:
        assert fingerprint(t.encode() if t is not None else None) == slow_fingerprint(t), t


def test_bit_counts_over_chunks():
    h = np.random.default_rng(0).integers(0, 1 << 63, 70_000, dtype=np.uint64)
    assert bit_counts(np.stack([h, ~h]))[0].tolist() == [int((h >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]


@pytest.mark.parametrize("hot_rows", [100_000, 3])
def test_links_connect_what_is_near(spark, hot_rows):
    rng = random.Random(7)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        fps.add(base)
        for d in range(1, 7):
            flips = rng.sample(range(64), d)
            fps.add(base ^ sum(1 << b for b in flips))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = [(r.a, r.b) for r in near_links(df, 4, hot_rows=hot_rows, rows_at_once=64).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 and a < b for a, b in links)
    assert len(links) == len(set(links))
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    got = [roots.get(s, s) for s in signed]
    want = slow_groups(list(zip(range(len(fps)), fps)), 4)
    assert len({*zip(got, want)}) == len(set(got)) == len(set(want))


def test_groups_with_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "one"), (3, "one"), (50, "very long " * 20000), (None, "alone here now ok")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, fp int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(docs).collect()), key=str)
    nodes = [(i, slow_fingerprint(t)) for i, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(nodes, slow_groups(nodes, 4))), key=str)
    assert got == want


def test_empty_table(spark):
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_long_path_is_one_component(spark, monkeypatch, one_task):
    monkeypatch.setattr(components_module, "ONE_TASK", one_task)
    links = [(i, i + 1) for i in range(0, 200)] + [(1000, 1001)] + [(500, 500 + k) for k in range(1, 60)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert all(roots[i] == 0 for i in range(201)) and roots[1001] == roots[1000] == 1000 and roots[559] == 500


def test_joining_in_one_task_against_a_search():
    rng = np.random.default_rng(5)
    for nodes, links in ((50, 20), (50, 45), (400, 380), (1000, 3000)):
        a, b = rng.integers(-nodes, nodes, (2, links))
        near = {}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            near.setdefault(x, set()).add(y)
            near.setdefault(y, set()).add(x)
        least = {}
        for start in sorted(near):
            todo = [start] if start not in least else []
            while todo:
                x = todo.pop()
                if x not in least:
                    least[x] = start
                    todo += near[x]
        assert dict(zip(*(x.tolist() for x in joined(a, b)), strict=True)) == least
    path = rng.permutation(20_000)
    assert (joined(path[:-1], path[1:])[1] == 0).all()
