"""Odd rows for every operator: nulls, empty and long texts, ties, repeats, clashing columns, empty tables; against brute force."""

import hashlib
import html
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from codeloom.llm import html_tree
from codeloom.llm.common import hash_filter, passes, running_total, skew_join, with_filter
from codeloom.llm.decontaminate import clean_documents, contaminated
from codeloom.llm.exact_dedup import MergeIndex, exact_dedup
from codeloom.llm.html_tree import extract_pages, parse, main_text
from codeloom.llm.langid import codewords, identify_languages, keep_identified
from codeloom.llm.mixing import fit_rates, label_domains, mix_documents, take_mixed
from codeloom.llm.secret_scan import ANY, BASE_RULES, secret_digest, trigram_query
from codeloom.llm.sharding import kd_shards
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra="digest string, row int, spans int, shard int, rate double"):
    rows = [(i, t, lang, src, None, None, 1, 2, 3, 0.5) for i, t, lang, src in texts]
    return spark.createDataFrame(rows, f"{DOCS}, {extra}")


ODD = [
    (1, "Hello there  world", "en", "a"), (2, "Hellothere\tworld", "en", None), (3, "Hello there world!", None, "b"), (4, None, None, None), (5, "", "en", "a"),
    (6, " \n\x0b", "de", "a"), (None, "Hello there world", "en", "a"), (7, "x" * 50_000, "en", "c"), (7, "x" * 50_000, "en", "c"), (8, "x " * 50_000, "en", "c"),
    (9, "ünïcödé 🙂 text", "de", "b"), (10, "1234 !!", "en", "b"),
]


# Shared helpers


def test_skew_join_filter_and_running_total(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    got = skew_join(rows, table, "k", "n", 20_000, F.col("id"), floor=100)
    assert got.count() == 20_000 and got.filter("m < id").count() == 0
    kept = with_filter(rows, F.col("id"), hash_filter(rows.filter("id < 500"), F.col("id"))).filter(passes())
    assert {r.id for r in kept.collect()} >= set(range(500)) and kept.count() == 500
    sums = running_total(spark.range(10_000), "id", "id", "before", block=37).collect()
    assert all(r.before == r.id * (r.id - 1) // 2 for r in sums)
    sums = running_total(spark.range(1000), "id", "id", "after", block=37, descending=True).collect()
    assert all(r.after == sum(range(r.id + 1, 1000)) for r in sums)


# Exact dedup


def slow_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[norm])
        out.append((i, best[3], len(groups[norm]), (-len(t or ""), i) == (best[0], best[3]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits,memtable", [(0, 65536), (3, 2), (0, 1)])
def test_exact_dedup(spark, bits, memtable):
    rng = random.Random(1)
    rows = [(r[0], r[1]) for r in ODD] + [(100 + k, " " * rng.randrange(3) + rng.choice("abc") * 2) for k in range(60)]
    docs = docs_of(spark, [(i, t, None, None) for i, t in rows])
    digest = (lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 1).cast("binary")) if bits else None
    index = MergeIndex(memtable_rows=memtable, fan_in=3, **({"digest": digest} if digest else {}))
    got = [tuple(r) for r in exact_dedup(docs, index).collect()]
    if bits:  # digests of one byte clash; groups must be told apart by the texts
        assert sorted((r[:4] for r in got), key=str) == sorted((r[:4] for r in slow_dedup(rows)), key=str)
    else:
        assert sorted(got, key=str) == slow_dedup(rows)
    assert exact_dedup(docs.limit(0)).count() == 0


# Sharding


def test_shards(spark):
    rng = random.Random(2)
    texts = [(i, t, lang, s) for i, t, lang, s in ODD] + [(1000 + k, "w " * int(rng.paretovariate(1.2) * 20), rng.choice(["en", "de"]), f"s{k % 5}") for k in range(800)]
    texts += [(5000 + k, "the same text " * 30, "en", "s0") for k in range(400)]
    for n in (7, 40):
        rows = kd_shards(docs_of(spark, texts), n, slot_rows=10).collect()
        assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)
        sizes, slots, groups = Counter(), defaultdict(list), defaultdict(set)
        for r in rows:
            sizes[r.shard] += r["size"]
            slots[r.shard].append(r.slot)
            groups[r.text_crc32].add(r.shard)
        assert set(sizes) == set(range(n)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert all(len(g) == 1 for g in groups.values())
        assert sum(r["size"] for r in rows) == sum(len((t or "").encode()) + 16 for _, t, _, _ in texts)
    assert kd_shards(docs_of(spark, ODD[:2]), 40).count() == 2
    assert kd_shards(docs_of(spark, ODD).limit(0), 40).count() == 0


def test_shards_are_near_equal(spark):
    texts = [(k, f"{k} " + "w " * (k * 7 % 400), "en", f"s{k % 9}") for k in range(3000)]
    sizes = kd_shards(docs_of(spark, texts), 40).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    each = [r.b for r in sizes]
    assert max(each) < 1.1 * np.mean(each) and min(each) > 0.9 * np.mean(each)


# Pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article class="post"><h1>Title &amp; more</h1><p>One<b> two</b>
three<br>four &lt;x&gt; &copy; &#233;<p>Five<script>var a="</p>";</script> six</p><div class="ad">Buy</div><ul><li>a<li>b</ul>
<section id="comments"><article>first!</article></section></article><aside>Side</aside><form><p>Mail</p></form><footer>Foot</footer>"""


def test_main_text():
    text = main_text(parse(PAGE), {}, set())
    assert text == "Title & more\nOne two three four <x> © é\nFive six\na\nb"
    assert main_text(parse(None), {}, set()) == main_text(parse(""), {}, set()) == ""
    assert main_text(parse("<article>cut &am"), {}, set()) == "cut &am" and main_text(parse("<article><p>a</p><p cla"), {}, set()) == "a"
    assert main_text(parse("a < b <!-- c --> d"), {}, set()) == "a < b d" and main_text(parse("<p>" * 3000 + "deep"), {}, set()) == "deep"
    assert main_text(parse("<div>" * 5000 + "deep"), {}, set()) == "deep"


def test_trees_cut_what_pages_share(spark):
    pages = []
    for k in range(30):
        body = f"<div class='a'><div>Shop</div><div>Cart</div></div><div class='b'><p>Story {k} tells {k * k}.</p><p>And {k + 7} more.</p></div><div class='c'>All rights</div>"
        pages.append((k, f"http://u@Site.example:80/p/{k}", f"<html><body>{body}</body></html>", k))
    pages += [(99, None, None, 0), (100, "x", "<p>only</p>", 0), (100, "x", "<p>only</p>", 0)]
    got = {r.page_id: r for r in extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string, low int")).collect()}
    assert all(got[k].text == f"Story {k} tells {k * k}.\nAnd {k + 7} more." for k in range(30))
    assert (got[99].text, got[99].n_chars, got[100].text) == ("", 0, "only")
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_trees_cut_what_articles_share(spark):
    """Boilerplate without a telling class goes inside article and main as well; what differs stays."""
    pages = []
    for k in range(30):
        tag = ("article", "main")[k // 15]
        inner = f"<h1>Title {k}</h1><div><span>Read this on our site</span></div><p>Story {k} tells {k * k}.</p><section><p>Part {k}</p><b>Pass it on</b></section>"
        pages.append((k, f"http://{tag}.example/p/{k}", f"<html><body><{tag}>{inner}</{tag}></body></html>"))
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Title {k}\nStory {k} tells {k * k}.\nPart {k}" for k in range(30))


def test_joined_hosts_give_the_same(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {(r.page_id, r.text) for r in extract_pages(pages).collect()}
    monkeypatch.setattr(html_tree, "BROADCAST_ROWS", 0)
    assert {(r.page_id, r.text) for r in extract_pages(pages).collect()} == want

    def plain(page):
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", page, re.S)[1]
        parts = re.sub(r"</?(?:p|h1)>", "\0", re.sub(r"</?b>", "", inner.replace("<br>", " "))).split("\0")
        return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*$", "", p)).split()) for p in parts) if x)

    assert want == {(r.page_id, plain(r.html)) for r in pages.collect()}


# Languages


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = docs_of(spark, ODD).select("doc_id", "text", "lang")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = identify_languages(docs.withColumn("doc_id", F.col("doc_id") + 1000).unionByName(odd)).collect()
    assert len(rows) == len(lang) + len(ODD) and all(0 <= r.score <= 1 for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    known = [r for r in rows if (r.doc_id or 0) >= 1000 and r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id - 1000] for r in known]) > 0.97
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {4, 5, 6, 10}
    assert {r.lang_pred for r in identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert identify_languages(docs.limit(0)).count() == 0
    kept = keep_identified(docs_of(spark, ODD))
    assert kept.columns == docs_of(spark, ODD).columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, None, 7, 8, 9}


@pytest.mark.parametrize("n", [2, 3, 4, 6, 9, 30])
def test_codewords_are_apart(n):
    code = codewords(n)
    gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(gaps) >= 1 and len({tuple(c) for c in code}) == n and (np.abs(code.sum(axis=0)) < n).all()
    assert n < 4 or min(gaps) >= 3


# Benchmarks


def slow_windows(docs, items, t=0.8):
    word = lambda s: [w for w in re.split(r"[^\w]+|_", (s or "").lower()) if w]
    out = {}
    for i, text in docs:
        ws = word(text)
        for k, item in items:
            its = word(item)
            size = min(5, len(its))
            if not its or len(ws) < size:
                continue
            grams = lambda x: Counter(tuple(x[a : a + size]) for a in range(len(x) - size + 1))
            want, best = grams(its), 0.0
            for a in range(max(1, len(ws) - len(its) + 1)):
                own = grams(ws[a : a + len(its)])
                best = max(best, sum((own & want).values()) / max(1, sum((own | want).values())))
            if best >= t:
                out[i, k] = best
    return out


def test_benchmark_windows(spark):
    rng = random.Random(5)
    w = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(rng.randrange(40)) for _ in range(n))
    items = [(k, w(rng.choice([15, 30, 60]))) for k in range(12)] + [(20, "just three words"), (21, None), (22, " .. "), (23, "same " * 20), (None, w(20)), (24, w(300))]
    docs = [(k, w(rng.randrange(0, 400))) for k in range(20)]
    for k, (_, text) in enumerate(items[:12]):
        words = text.split()
        docs.append((100 + k, w(50) + " " + text.upper().replace(" ", ",  ") + " " + w(20)))
        words[len(words) // 2] = "changed"
        docs.append((200 + k, w(30) + " " + " ".join(words) + " " + w(9)))
        docs.append((300 + k, " ".join(text.split()[: int(len(text.split()) * 0.9)])))
        docs.append((400 + k, w(5) + " " + " ".join(text.split()[:8]) + " " + w(70)))
    docs += [(500, "so just three  WORDS here"), (501, "same " * 200), (502, None), (503, ""), (504, items[17][1]), (None, items[0][1]), (100, "repeated id"), (505, items[16][1])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, start int")
    bench = spark.createDataFrame([(k, t, 0) for k, t in items], "item_id long, text string, hash int")
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(df, bench).collect()}
    want = slow_windows(docs, items)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    left = clean_documents(df, bench)
    assert left.columns == df.columns
    dirty = {i for i, _ in want}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, t in docs if i not in dirty or t == "repeated id")
    assert contaminated(df.limit(0), bench).count() == 0 and contaminated(df, bench.limit(0)).count() == 0 and clean_documents(df, bench.limit(0)).count() == len(docs)


# Secrets


SECRETS = [
    None, "", "plain text", 'password="hunter22xyz" x', "API_KEY: abc", "apikey = 'abcdef'", "Token==abcdef", "secret: token : abcdefgh", "SECRET=a secret=abcdefgh",
    "AKIA" + "A1" * 8, "AKIAAKIA" + "Z" * 15, "AKIASHORT", "é🙂 " + "deadbeef" * 3 + "g" + "0" * 23, "f" * 24 + "\n" + "e" * 100, "-----BEGIN RSA PRIVATE KEY-----",
    "ghp_" + "a" * 36, "eyJab.eyJcd.ef-_", "passwd:x" * 5, "token=" + "ab" * 30_000,
]


def slow_secrets(t):
    spans = []
    for k, rule in enumerate(BASE_RULES):
        spans += [(m.start(), k, m.end()) for m in re.finditer(rule.pattern, t or "", re.A) if len(m[rule.group]) >= rule.least]
    spans.sort()
    said = ",".join(f"{BASE_RULES[k].kind}:{a}:{b}" for a, k, b in spans)
    return [sum(s[1] == k for s in spans) for k in range(3)] + [hashlib.sha256(said.encode()).hexdigest()]


def test_secrets(spark):
    rows = [(k, t) for k, t in enumerate(SECRETS)] + [(None, SECRETS[3]), (3, SECRETS[3])]
    got = secret_digest(spark.createDataFrame([(i, t, 9, 9) for i, t in rows], "doc_id long, text string, spans int, doc int")).collect()
    key = lambda r: str(r)
    assert sorted(([r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256] for r in got), key=key) == sorted(([i, *slow_secrets(t)] for i, t in rows), key=key)
    spans = {r.doc_id: r.spans for r in got}
    assert spans[14] == "private_key:0:31" and spans[15].startswith("code_host:0:40") and "jwt" in spans[16]
    assert secret_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trigram_queries():
    assert trigram_query("[0-9a-f]+") == ANY and trigram_query("a.c") == ANY and trigram_query("(abc)?") == ANY
    assert trigram_query("abc.*xyz") == {frozenset({"abc", "xyz"})} and trigram_query("abcd|xyz") == {frozenset({"abc", "bcd"}), frozenset({"xyz"})}
    assert trigram_query("A[bc]d+ef") == {frozenset({"abd"}), frozenset({"acd"})} or trigram_query("A[bc]d") == {frozenset({"abd"}), frozenset({"acd"})}
    rng = random.Random(3)
    for rule in BASE_RULES:  # whatever matches satisfies the query
        query = trigram_query(rule.pattern)
        for t in SECRETS + ["".join(rng.choice("pasword=tkn:AKI1f") for _ in range(200)) for _ in range(50)]:
            if re.search(rule.pattern, t or ""):
                assert any(all(g in t.lower() for g in clause) for clause in query)


# Mixing


def test_rates_meet_targets_where_they_can(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 500)
    n = rng.integers(0, 400, 500)
    rows = spark.createDataFrame([(int(n[k]), *map(float, p[k])) for k in range(500)], "n_tokens long, p0 double, p1 double, p2 double")
    rated, _ = fit_rates(rows, [0.5, 0.3, 0.2])
    got = np.array([[r.n_tokens, r.p0, r.p1, r.p2, r.rate] for r in rated.collect()])
    mass = (got[:, :1] * got[:, 1:4] * got[:, 4:]).sum(axis=0)
    assert (got[:, 4] >= 0).all() and mass / n.sum() == pytest.approx([0.5, 0.3, 0.2], abs=1e-3)
    rated, _ = fit_rates(rows, [1.0, 0.0, 0.0])
    assert rated.filter("rate < 0").count() == 0


def test_mixing_odd_rows(spark):
    texts = [(k, ("good words here " if k % 3 else "bad junk ") * 9, "en", "a") for k in range(60)] + [(100 + r[0] if r[0] else None, *r[1:]) for r in ODD]
    docs = docs_of(spark, texts)
    labels = label_domains(spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(40)] + [(None, 1, 0), (3, None, None), (5, 0, 1), (999, 1, 1)], "doc_id long, quality int, toxic int"))
    rows = mix_documents(docs, labels, {"good": 0.9, "poor": 0.1, "other": 5.0}).collect()
    assert len(rows) == len(texts) and all(r.rate >= 0 and r.copies >= 0 and abs(r.copies - r.rate) <= 1 for r in rows)
    assert all(r.p_good + r.p_poor + r.p_toxic == pytest.approx(1) for r in rows)
    assert np.mean([r.p_poor > 0.5 for r in rows if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 3 == 0]) > 0.9
    taken = take_mixed(docs, labels, {"good": 0.9, "poor": 0.1})
    assert taken.columns == docs.columns
    assert taken.count() == mix_documents(docs, labels, {"good": 0.9, "poor": 0.1}).agg(F.sum("copies")).first()[0]
    plain = mix_documents(docs, labels.limit(0), {"good": 1.0}).collect()
    assert {(r.rate, r.copies) for r in plain} == {(1.0, 1)} and mix_documents(docs.limit(0), labels, {"good": 1.0}).count() == 0


# Pipeline


def test_stages(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    odd = docs_of(spark, ODD).select(*pipeline.COLUMNS)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*pipeline.COLUMNS).unionByName(odd)
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        sizes.append(docs.count())
        if k < 4:
            assert tuple(docs.columns) == pipeline.COLUMNS
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[4] == sizes[5]
    assert {r.shard for r in docs.collect()} <= set(range(40))
    for _, stage in pipeline.STAGES:
        assert stage(spark, odd.limit(0), sf).count() == 0
