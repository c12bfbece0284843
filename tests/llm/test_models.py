"""Classifiers, rates, cuts and scans against versions of their own in plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codeloom.llm import langid, sharding
from codeloom.llm.langid import BUCKETS, PIECE, fit_languages, gram_counts, keep_identified
from codeloom.llm.mixing import fit_domains, fit_rates, posteriors, take_mixed
from codeloom.llm.secret_scan import MORE_RULES, Rule, _tight, candidates, secret_spans
from codeloom.llm.sharding import kd_shards
from codeloom.llm.tokenizing import WordEncoder, splits_at_space

WORDS = {"good": "fine prose that tells a story of rivers and hills".split(), "poor": "buy cheap click now win big money fast".split(), "toxic": "hate fool idiot stupid trash".split()}
PRIOR, TEMPER, HASHED = 20_000.0, 400, 1 << 14


def labelled(rng, each=40):
    texts, labels = [], []
    for k, domain in enumerate(list(WORDS) * each):
        own = [rng.choice(WORDS[domain if rng.random() < 0.8 else rng.choice(list(WORDS))]) for _ in range(rng.randrange(1, 900))]
        texts.append((k, " ".join(own).replace("fine", "Fine")))
        if k % 4:
            labels.append((k, domain))
    return texts + [(900, None), (901, ""), (902, " \n")], labels


def bucket(word):
    return xxhash.xxh64_intdigest(word.encode(), 42) % HASHED  # as a signed long modulo a power of two, too


def slow_posteriors(texts, labels):
    split = lambda t: [w for w in re.split(r"[ \t-\r]+", (t or "").lower()) if w]
    counts, rows = defaultdict(Counter), Counter()
    named = dict(labels)
    for k, t in texts:
        if k in named:
            rows[named[k]] += 1
            counts[named[k]].update(map(bucket, split(t)))
    domains, everything = sorted(rows), sum(counts.values(), Counter())
    total = sum(everything.values())
    average = lambda b: (everything[b] + 0.5) / (total + 0.5 * HASHED)
    out = {}
    for k, t in texts:
        words = split(t)
        logits = []
        for d in domains:
            share = sum(counts[d].values()) + PRIOR
            score = sum(math.log((counts[d][bucket(w)] + PRIOR * average(bucket(w))) / share / average(bucket(w))) for w in words)
            logits.append(score / max(1.0, len(words) / TEMPER) + math.log(rows[d] / sum(rows.values())))
        top = max(logits)
        e = [math.exp(x - top) for x in logits]
        out[k] = [x / sum(e) for x in e]
    return domains, out


def test_posteriors_against_a_classifier_of_its_own(spark):
    texts, labels = labelled(random.Random(1))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = fit_domains(docs, spark.createDataFrame(labels, "doc_id long, domain string"))
    domains, want = slow_posteriors(texts, labels)
    assert model[0] == domains
    for r in posteriors(docs, model, ["doc_id"]).collect():
        assert [r[f"p{i}"] for i in range(3)] == pytest.approx(want[r.doc_id], abs=2e-3), r.doc_id


@pytest.mark.parametrize("targets", [[0.5, 0.3, 0.2], [0.0, 0.0, 1.0]])
def test_rates_against_coordinate_descent(spark, targets):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([2.0, 1.0, 0.4], 60)
    tokens = rng.integers(1, 500, 60)
    rows = spark.createDataFrame([(int(k), int(n), *map(float, x)) for k, (n, x) in enumerate(zip(tokens, p, strict=True))], "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    rated, expected = fit_rates(rows, targets)
    a = (tokens[:, None] * p).T
    metric = np.linalg.pinv((p * tokens[:, None]).T @ p, rcond=1e-9)
    goal = np.array(targets) * tokens.sum()
    misfit = lambda r: float((a @ r - goal) @ metric @ (a @ r - goal))
    rates = np.ones(60)
    for _ in range(3000):
        for i in range(60):
            rates[i] = max(0.0, rates[i] - a[:, i] @ metric @ (a @ rates - goal) / (a[:, i] @ metric @ a[:, i]))
    got = np.array([r.rate for r in rated.orderBy("doc_id").collect()])
    assert (got >= 0).all() and a @ got == pytest.approx(np.array(expected), rel=1e-6)
    assert misfit(got) <= misfit(rates) * 1.01 + 1e-2


def test_rates_that_do_not_settle_are_told(spark, caplog):
    rows = spark.createDataFrame([(1, 10, 0.5, 0.5), (2, 10, 0.2, 0.8)], "doc_id long, n_tokens long, p0 double, p1 double")
    with caplog.at_level("WARNING", logger="codeloom"):
        _, expected = fit_rates(rows, [0.99, 0.01], steps=1)
    assert "have not settled" in caplog.text and len(expected) == 2


def test_clashing_names(spark):
    names = ("__u", "__k", "__copies", "row", "doc", "copies", "n", "__salt", "col", "rate", "score", "lang_pred", "__found")
    texts, labels = labelled(random.Random(5), each=4)
    rows = [(k, t, "en", *[f"x{k}"] * len(names)) for k, t in texts + texts[:3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    label_rows = spark.createDataFrame(labels, "doc_id long, domain string")
    taken = take_mixed(docs, label_rows, {"good": 0.5, "poor": 0.4, "toxic": 0.1})
    assert taken.columns == docs.columns and {tuple(r) for r in taken.collect()} <= set(rows)
    assert sorted(tuple(r) for r in take_mixed(docs, label_rows, {}).select("doc_id", "__u").collect()) == sorted((r[0], r[3]) for r in rows)
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == sorted(r for r in rows if (r[1] or "").strip())
    assert keep_identified(docs.limit(0)).count() == take_mixed(docs.limit(0), label_rows, {"good": 1.0}).count() == 0


# Languages


def test_decoding_against_a_slow_one(spark):
    rng = random.Random(2)
    alphabet = {"aa": "abcde", "bb": "cdefg", "cc": "éèêab", "dd": "xyzab"}
    text = lambda lang, n: " ".join("".join(rng.choice(alphabet[lang]) for _ in range(5)) for _ in range(n))
    rows = [(k, text(lang, 30), lang) for k, lang in enumerate(list(alphabet) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    coder = fit_languages(docs)
    again = fit_languages(docs.repartition(13))
    assert (coder.weights == again.weights).all() and (coder.trust == again.trust).all()  # whatever the layout
    for t in [text(lang, n) for lang in alphabet for n in (1, 3, 200)] + ["a", "zzzz aaaa"]:
        counts = gram_counts(t.encode())
        total = max(int(counts.sum()), 1)
        margins = [sum(int(counts[g]) * float(coder.weights[g, b]) for g in np.flatnonzero(counts)) / total for b in range(coder.code.shape[1])]
        sharp = [m * min(max(math.sqrt(total), 1), 20) for m in margins]
        losses = [sum(coder.trust[b] * math.log1p(math.exp(-sharp[b] * w[b])) for b in range(len(w))) for w in coder.code]
        odds = [math.exp(min(losses) - x) for x in losses]
        share = sorted(x / sum(odds) for x in odds)
        best, score, unsure = coder.decode(counts[None, :])
        assert losses[best[0]] == pytest.approx(min(losses)) and score[0] == pytest.approx(share[-1], abs=1e-5)
        assert bool(unsure[0]) == (share[-1] - share[-2] < coder.ambiguous_gap)


def test_grams_over_the_seams_of_long_texts(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("ab  é\nZ7") for _ in range(5000)).encode()
    whole = gram_counts(text)
    for piece in (1, 2, 3, 7, 100, 4999, 5000):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert (gram_counts(text) == whole).all(), piece
    monkeypatch.undo()
    long = text * (2 * PIECE // len(text) + 2)
    assert len(long) > 2 * PIECE and gram_counts(long).sum() > 0 and len(whole) == BUCKETS
    monkeypatch.setattr(langid, "PIECE", len(long) + 1)
    assert (gram_counts(long) == _counted(long, monkeypatch)).all()


def _counted(long, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", PIECE)
    return gram_counts(long)


def test_too_many_languages_are_told(spark):
    docs = spark.createDataFrame([(k, "some text", f"l{k}") for k in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        fit_languages(docs, max_languages=3)


# Shards


def test_shards_row_by_row(spark):
    rng = random.Random(6)
    texts = [None, "", "é🙂", "same", "same"] + ["".join(rng.choice("abc é") for _ in range(int(rng.paretovariate(1.1) * 40) % 9000)) for _ in range(2500)]
    rows = [(k, t, rng.choice(("en", "de", None)), f"s{rng.randrange(7)}") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in kd_shards(docs, 40).collect()}
    assert len(out) == len(rows)
    for k, t, _, _ in rows:
        raw = (t or "").encode()
        assert (out[k]["size"], out[k].text_crc32, out[k].law, out[k].grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    sizes = Counter()
    for r in out.values():
        sizes[r.shard] += r["size"]
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and max(sizes.values()) < 1.05 * mean and min(sizes.values()) > 0.95 * mean
    assert out[0].shard == out[1].shard and out[3].shard == out[4].shard


def test_points_that_change_sides(spark):
    points = spark.createDataFrame([("a", 0, 50, True), ("b", 0, 30, True), ("c", 0, 7, True), ("d", 0, 13, False), ("e", 1, 5, True), ("f", 1, 5, False)], "group string, node int, weight long, lesser boolean")
    found = {r.group: r.x for r in points.withColumn("x", sharding._trimmed(points, {0: 50.0, 1: 5.0})).collect()}
    left = sum(w for g, w in (("a", 50), ("b", 30), ("c", 7), ("d", 13)) if found[g])
    assert left == 50 and (found["e"], found["f"]) == (True, False)


# Secrets


def test_long_literals_and_least_lengths(spark):
    literal = "key-" + "".join(chr(97 + k % 26) + str(k % 7) for k in range(33))
    rule = Rule("long", literal + "[0-9]+", 0, len(literal) + 2)
    docs = spark.createDataFrame([(1, f"x {literal}123 y"), (2, f"x {literal}1 y"), (3, literal[:-1]), (4, None)], "doc_id long, text string")
    assert len(literal) == 70 and {r.doc for r in candidates(docs, [rule]).collect()} == {r.d for r in docs.filter("doc_id < 3").select(F.xxhash64("doc_id", "text").alias("d")).collect()}
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in secret_spans(docs, (rule,)).collect()}
    assert spans == {1: [(2, 75)], 2: [], 3: [], 4: []}
    for rule in MORE_RULES:
        tight = _tight(rule)
        assert (tight == rule) or re.fullmatch(tight.pattern, ("gh" + "p_" + "a" * (rule.least - 4))) and not re.search(tight.pattern, "gh" + "p_" + "a" * (rule.least - 5))


# Tokenizers


def test_unknown_fronts_get_whole_texts(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    settings = json.loads(open(path, encoding="utf-8").read())
    assert splits_at_space(settings) and WordEncoder(path).in_pieces
    settings["normalizer"] = None
    other = tmp_path / "other.json"
    other.write_text(json.dumps(settings), "utf-8")
    words, plain = WordEncoder(str(other)), Tokenizer.from_file(str(other))
    assert not words.in_pieces
    for text in ("Two  Words, don't", "", "É́ x"):
        assert list(np.frombuffer(words.encode(text.encode()), words.dtype)) == plain.encode(text, add_special_tokens=False).ids
