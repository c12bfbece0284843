import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codeloom.llm import html_tree
from codeloom.llm.html_tree import extract_pages, main_text, page_features, parse, style_tree, tree_rows


def pages_of(spark, rows):
    return spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def text_of(spark, rows):
    return [r.text for r in extract_pages(pages_of(spark, rows)).orderBy("page_id").collect()]


def story(k):
    return f"Story {k} tells at some length of matter {k * 7} and of nothing else that any other page holds {k * k}."


def test_hosts_without_main_elements(spark):
    rows = [("http://plain.example/", f"<body><div><span>Home</span><span>About</span></div><div><p>{story(k)}</p></div><table><tr><td>Call us</td></tr></table></body>") for k in range(20)]
    assert text_of(spark, rows) == [story(k) for k in range(20)]


def test_boilerplate_inside_an_article(spark, monkeypatch):
    page = "<body><article><h1>Head {k}</h1><p>{story}</p><p>Share this story with all your friends</p><div><i>Signed by the editors</i></div></article></body>"
    rows = [("http://a.example/x", page.format(k=k, story=story(k))) for k in range(40)]
    alone = [("http://b.example/x", page.format(k=77, story=story(77)))]
    got = text_of(spark, rows + alone)
    assert got[:40] == [f"Head {k}\n{story(k)}" for k in range(40)]
    assert got[40].count("\n") == 3  # a host of one page shares nothing
    monkeypatch.setattr(html_tree, "style_tree", lambda features, lean, f=style_tree: f(features, lean).limit(0))
    assert [t.count("\n") for t in text_of(spark, rows)] == [3] * 40


def test_names_are_whole_or_a_prior(spark):
    inner = '<div class="form-factor">A form factor {k}</div><p class="tags-intro">Tags {k}</p><ul class="search-results-study"><li>Study {k}</li></ul><math><mi>x{k}</mi></math>'
    rows = [("http://n.example/", f"<body><article><p>{story(k)}</p>{inner.format(k=k)}<p class='ad big'>Buy {k}</p></article></body>") for k in range(12)]
    assert text_of(spark, rows) == [f"{story(k)}\nA form factor {k}\nTags {k}\nStudy {k}\nx{k}" for k in range(12)]
    footer = "<body><div><p>{story}</p></div><div class='site-footer'>Bye</div></body>"
    assert text_of(spark, [("http://one.example/", footer.format(story=story(1)))]) == [story(1)]


def test_copies_of_a_page_share_nothing(spark):
    rows = [("http://c.example/", f"<body><article><p>{story(1)}</p><p>Short end</p></article><!-- {k} --></body>") for k in range(60)]
    assert text_of(spark, rows) == [f"{story(1)}\nShort end"] * 60


def slow_tree(rows, lean=8):
    """host, path -> importance of elements and (path, feature) of texts, recomputed page by page."""
    seen = defaultdict(set)
    priors = {}
    for host, page in rows:
        own, found = tree_rows(parse(page))
        for path, prior, what, feature in found:
            seen[host, path, what, feature].add(own)
            priors[path] = prior
    k = {key: len(v) for key, v in seen.items()}
    every = Counter()
    for (_, path, what, feature), n in k.items():
        every["*", path, what, feature] += n
    out = {}
    weights = {}
    for table in (every, k):
        for host, path in {(h, p) for h, p, _, _ in table}:
            shown = [n for (h, p, w, _), n in table.items() if (h, p, w) == (host, path, 0)]
            texts = [n for (h, p, w, _), n in table.items() if (h, p, w) == (host, path, 1)]
            m = sum(shown)
            less = lambda x, m=m: 1.0 if m <= 1 else max(0.0, 1 - x / math.log(m))
            w = less(sum(map(math.log, texts)) / len(texts)) if texts else less(sum(n * math.log(n) for n in shown) / m)
            weights[host, path] = w
            if host != "*":
                prior = weights["*", path] if priors[path] is None else priors[path]
                out[host, path, None] = (w * m + prior * lean) / (m + lean)
                for (h, p, what, feature), n in table.items():
                    if (h, p, what) == (host, path, 1) and n > 1:
                        out[host, path, feature] = ((1 - n / m) * m + prior * lean) / (m + lean)
    return out


def test_tree_against_slow_one(spark):
    rows = []
    for k in range(30):
        host = ("x.example", "y.example", "z.example")[k % 3 if k < 20 else 0]
        rows.append((host, f"<body><div><p>{story(k)}</p><p>Same on all</p></div><div class='nav-bar'>Go {k % 2}</div><article><b>{k % 4}</b>{'<i>i</i>' * (k % 3)}</article></body>"))
    features = page_features(pages_of(spark, [(f"http://{h}/p", page) for h, page in rows]))
    got = {(r.host, r.path, r.feature): r.importance for r in style_tree(features).collect()}
    want = slow_tree(rows)
    assert set(got) == set(want) and all(got[key] == pytest.approx(want[key]) for key in want)


def test_long_and_deep_pages():
    page = "<article>" + "<p>word </p>" * 50_000 + "<div>" * 3000 + "deep" + "</article>"
    text = main_text(parse(page), {}, set())
    assert text.count("\n") == 50_000 and text.endswith("deep")


def test_shuffled_lists_give_the_same(spark, monkeypatch):
    rows = [(f"http://h{k % 3}.example/", f"<body><div>Menu</div><div><p>{story(k)}</p></div><div>Menu</div></body>") for k in range(60)] + [(None, None), ("http://h0.example/", "")]
    want = text_of(spark, rows)
    monkeypatch.setattr(html_tree, "BROADCAST_ROWS", 0)
    assert text_of(spark, rows) == want and want[:60] == [story(k) for k in range(60)]
    assert extract_pages(pages_of(spark, rows).withColumn("low", F.lit(1)).withColumn("host", F.lit(1))).count() == 62
