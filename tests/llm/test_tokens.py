import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codeloom.llm.common import shared_path
from codeloom.llm.token_counts import budget_at, length_histogram, token_budgets
from codeloom.llm.token_store import EliasFano, ShardReader, read_tokens, write_tokens
from codeloom.llm.tokenizing import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n ", "Hello, World's end!", "ﬁne é x İstanbul ΣΑΣ <|endoftext|> a<|endoftext|>b", "1234 \x1c!?  x", "don't\tstop\r\nnow", "w" * 3000, "the cat " * 4000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_cached_words_equal_whole_texts(tokenizer):
    words = WordEncoder(PATH, max_cached=3)
    for t in TEXTS:
        want = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(words.encode(t.encode() if t is not None else None), words.dtype).tolist() == want


@pytest.mark.parametrize("values", [[], [0], [5], [0] * 700, list(range(2000)), [0, 1 << 40], [1 << 62]])
def test_elias_fano(values):
    ef = EliasFano(EliasFano.encode(np.array(values, np.uint64)))
    assert [ef.get(i) for i in range(len(ef))] == values
    assert ef.slice(0, len(values)).tolist() == values
    with pytest.raises(IndexError):
        ef.get(len(values))


def test_elias_fano_random():
    rng = random.Random(3)
    for n, top in ((1000, 10), (5000, 10**6), (3, 10**9), (9999, 10**4)):
        values = sorted(rng.randrange(top) for _ in range(n))
        raw = EliasFano.encode(np.array(values, np.uint64))
        ef = EliasFano(raw)
        for a in (0, n // 3, n - 1):
            assert ef.slice(a, min(n, a + 700)).tolist() == values[a : a + 700]
        assert len(raw) * 8 / n < 3.2 + max(0, np.log2(top / n)) + 800 / n


def test_files_round_trip(spark, tokenizer):
    rows = [(100 - 7 * i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (-5, "minus"), (100, "again"), (None, "x y")]
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, n_tokens int, shard string")
    manifest = write_tokens(docs, shared_path(spark, "t"), PATH, 2, shard_rows=3)
    got = [tuple(r) for r in read_tokens(manifest).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert len(got) == len(rows) and manifest.count() > 2
    got.sort(key=lambda r: r[1])
    keys = [-(10**9) if r[0] is None else r[0] for r in got]
    assert keys == sorted(keys)
    at, want = 0, {}
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(i, set()).add((len(ids), zlib.crc32(ids.tobytes())))
    for d, start, n, crc in got:
        assert start == at and (n, crc) in want[d]
        at += n
    path = manifest.orderBy("shard").first().path
    reader = ShardReader(path)
    assert [reader.tokens(i).tolist() for i in range(reader.n_docs)] == [ids.tolist() for _, _, ids in reader.documents(chunk=1)]


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert read_tokens(write_tokens(none, shared_path(spark, "t"), PATH, 2)).count() == 0
    assert token_budgets(length_histogram(none, PATH)).count() == 0


def test_budgets_against_brute_force(spark, tokenizer):
    texts = TEXTS + ["a b c"] * 5 + ["word " * k for k in range(60)]
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, n_docs int")
    budgets = token_budgets(length_histogram(docs, PATH)).cache()
    lengths = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    rows = budgets.collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(lengths))
    for r in rows:
        cut = sum(min(x, r.n_tokens) for x in lengths)
        assert (r.n_docs, r.docs_longer) == (lengths.count(r.n_tokens), sum(x > r.n_tokens for x in lengths))
        assert (r.tokens_total, r.tokens_truncated, r.tokens_lost) == (sum(lengths), cut, sum(lengths) - cut)
        assert r.quantile == pytest.approx(sum(x <= r.n_tokens for x in lengths) / len(lengths))
    for limit in (0, 7, 33, 10**6):
        assert budget_at(budgets, limit)["tokens_truncated"] == sum(min(x, limit) for x in lengths)


def test_every_document_of_a_table(tokenizer):
    import pyarrow.parquet as pq

    words = WordEncoder(PATH, max_cached=20_000)
    for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist():
        want = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(words.encode(t.encode()), words.dtype).tolist() == want


def test_pages_and_odd_characters(tokenizer):
    import pyarrow.parquet as pq

    odd = ["".join(chr(random.Random(k).randrange(1, 0x3000)) for _ in range(300)) for k in range(40)]
    words = WordEncoder(PATH)
    for t in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()[:60] + odd + ["é É", "a'S it's 'tis", "²½ x² ß ẞ ŉ"]:
        assert np.frombuffer(words.encode(t.encode()), words.dtype).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
