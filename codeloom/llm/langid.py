"""Language identification by error-correcting output codes over n-gram classifiers.

Each language has a codeword of bits; for each bit a binary naive Bayes classifier over hashed
byte bigrams and trigrams of letters tells the languages with a 1 from those with a 0. A text's margins are
decoded to the codeword of least loss, each bit's loss weighted by how seldom its classifier was wrong on
the training rows; a runner-up close behind makes the answer ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.llm.common import discard, materialize

BUCKETS = 1 << 14
SPACE = 32
PIECE = 1 << 20  # bytes of a text hashed at a time
#: ASCII letters in lower case, bytes of other characters as they are, everything else a space.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else SPACE for c in range(256)], np.uint8)


def gram_counts(text: bytes) -> np.ndarray:
    """Counts of hashed byte bigrams and trigrams of the folded text; runs of spaces count as one, and the text stands between spaces.

    Long texts are read in pieces; the last two bytes of one begin the next, and only grams that end in a new byte are counted.
    """
    out = np.zeros(BUCKETS, np.int64)
    tail = np.array([SPACE], np.uint32)
    for first in range(0, max(len(text), 1), PIECE):
        raw = FOLD[np.frombuffer(text[first : first + PIECE], np.uint8)].astype(np.uint32)
        end = [SPACE] if first + PIECE >= len(text) else []
        a = np.concatenate((tail, raw, np.array(end, np.uint32)))
        a = a[np.concatenate(([True], (a[1:] != SPACE) | (a[:-1] != SPACE)))]
        two = a[:-1] * np.uint32(0x9E3779B1) ^ a[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] ^ a[2:] * np.uint32(0xC2B2AE35)
        for h in (two[len(tail) - 1 :], three[max(len(tail), 2) - 2 :]):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out += np.bincount(h >> np.uint32(18), minlength=BUCKETS)
        tail = a[-2:]
    return out


def codewords(count: int, most_bits: int = 31) -> np.ndarray:
    """Rows of +1 and -1: the exhaustive code for up to 6 languages, far-apart random words for more."""
    if count < 2:
        return np.ones((count, 1))
    if count <= 6:  # all splits into two sides that are not empty, the first language always on the 1 side
        splits = [s for s in product((1, -1), repeat=count - 1) if -1 in s]
        return np.array([[1] * len(splits), *zip(*splits, strict=True)], float)
    rng, best, apart = np.random.default_rng(0), None, -1
    bits = max(most_bits, 4 * int(np.ceil(np.log2(count))))
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), (count, bits))
        gaps = ((bits - code @ code.T) / 2 + np.eye(count) * bits).min()
        mixed = (np.abs(code.sum(axis=0)) < count).all()
        if mixed and gaps > apart:
            best, apart = code, gaps
    return best


@dataclass
class LanguageCoder:
    """Fitted languages, codewords and per-bit weights of n-grams."""

    languages: list[str] = field(default_factory=list)
    code: np.ndarray = None
    weights: np.ndarray = None  # BUCKETS x bits
    trust: np.ndarray = None  # per bit, from training errors
    ambiguous_gap: float = 0.2

    @classmethod
    def fit(cls, counts: dict[str, np.ndarray], **options) -> LanguageCoder:
        """counts: n-gram counts of each language. All bits are trusted alike until ``trusting`` tells their errors."""
        languages = sorted(counts)
        code = codewords(len(languages))
        share = np.array([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * BUCKETS) for x in languages]) if languages else np.zeros((0, BUCKETS))
        weights = np.zeros((BUCKETS, code.shape[1]))
        if len(languages) > 1:
            for b in range(code.shape[1]):
                one, zero = code[:, b] > 0, code[:, b] < 0
                weights[:, b] = np.log(share[one].mean(axis=0)) - np.log(share[zero].mean(axis=0))
        return cls(languages, code, weights.astype(np.float32), np.ones(code.shape[1]), **options)

    def errors(self, lang: str, counts: np.ndarray) -> np.ndarray:
        """Per bit 1 where its classifier is wrong on a text of the language."""
        return (self.margins(counts[None, :])[0] * self.code[self.languages.index(lang)] <= 0).astype(np.int64)

    def trusting(self, wrong: np.ndarray, rows: int) -> LanguageCoder:
        """The same coder with bits weighted by their errors on so many training rows."""
        if rows and len(self.languages) > 1:
            share = (wrong / rows).clip(0.005, 0.45)
            self.trust = np.log((1 - share) / share)
            self.trust /= self.trust.mean()
        return self

    def margins(self, counts: np.ndarray) -> np.ndarray:
        """Mean log-odds of a text's n-grams for each bit."""
        return counts @ self.weights / np.maximum(counts.sum(axis=1, keepdims=True), 1)

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: position of the language of least weighted loss, score from 0 to 1, whether it is ambiguous."""
        margins = self.margins(counts)
        sharp = margins * np.sqrt(np.maximum(counts.sum(axis=1, keepdims=True), 1)).clip(1, 20)
        loss = np.stack([(self.trust * np.logaddexp(0, -sharp * word)).sum(axis=1) for word in self.code], axis=1)
        likely = np.exp(loss.min(axis=1, keepdims=True) - loss)
        likely /= likely.sum(axis=1, keepdims=True)
        order = np.sort(likely, axis=1)
        gap = order[:, -1] - (order[:, -2] if order.shape[1] > 1 else 0)
        return loss.argmin(axis=1), order[:, -1], gap < self.ambiguous_gap


def learning_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: lang and text present, and crc32 of doc_id's decimal form not 2 modulo 4."""
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())


def held_out():
    """True for the held-out fold; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_languages(docs: DataFrame, rows_each: int = 600, max_languages: int = 200, **options) -> LanguageCoder:
    """Fit on at most ``rows_each`` whole rows of each language, chosen by a hash of doc_id.

    The bound holds for training only. More than ``max_languages`` languages, which would be too much for the driver, raise.
    """
    rows = learning_rows(docs.select("doc_id", "text", "lang"))
    counted = rows.groupBy("lang").count().limit(max_languages + 1)
    sizes = {r["lang"]: r["count"] for r in counted.collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"over {max_languages} languages to learn: raise max_languages, or map them to fewer")
    if not sizes:
        return LanguageCoder.fit({}, **options)
    # A share of each language by the hash, four times what is wanted, keeps the window's groups small at any scale.
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, 4 * rows_each / n) * (1 << 30)))])
    near = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= F.element_at(share, F.col("lang"))
    first = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id", F.xxhash64("text"))
    chosen = rows.filter(near).withColumn("k", F.row_number().over(first))
    chosen = chosen.filter(F.col("k") <= rows_each).select("lang", F.col("text").cast("binary").alias("text"))
    chosen = materialize(chosen, "language_rows")

    def summed(batches, value):
        """One sum of ``value(lang, text)`` for each language of a task."""
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = value(lang, text)
                if found is not None:
                    sums[lang], rows[lang] = sums.get(lang, 0) + found, rows.get(lang, 0) + 1
        for lang, total in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "n": [rows[lang]], "sums": [total.astype(np.int64).tobytes()]})

    def added(value) -> tuple[dict[str, np.ndarray], int]:
        """Sums by language over all chosen rows, and their number; whole numbers, so the tasks' layout does not matter."""
        total, rows = {}, 0
        for r in chosen.mapInArrow(lambda batches: summed(batches, value), "lang string, n long, sums binary").toLocalIterator():
            total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.sums, np.int64)
            rows += r.n
        return total, rows

    def grams(lang, text):
        found = gram_counts(text)
        return found if found.any() else None

    coder = LanguageCoder.fit(added(grams)[0], **options)
    if len(coder.languages) > 1:
        shared = docs.sparkSession.sparkContext.broadcast(coder)
        wrong, number = added(lambda lang, text: None if (found := grams(lang, text)) is None else shared.value.errors(lang, found))
        coder.trusting(sum(wrong.values()), number)
    discard(chosen)
    return coder


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def predict_columns(docs: DataFrame, coder: LanguageCoder) -> DataFrame:
    """docs with lang_pred, score and ambiguous added; und for texts that are null or have no letter.

    Added columns replace columns of the same names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(coder)
    kind = "struct<lang_pred:string,score:double,ambiguous:boolean>"

    @F.pandas_udf(kind)
    def predict(texts):
        import pandas as pd

        model, out = shared.value, []
        for t in texts:
            if not has_letter(t) or not model.languages:
                out.append(("und", 0.0, True))
                continue
            best, score, unsure = model.decode(gram_counts(t.encode("utf-8", "replace"))[None, :])
            out.append((model.languages[best[0]], float(score[0]), bool(unsure[0])))
        return pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])

    found = docs.withColumn("__found", predict(F.col("text")))
    return found.withColumns({c: F.col("__found")[c] for c in ("lang_pred", "score", "ambiguous")}).drop("__found")


def identify_languages(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous.

    - ``und`` with score 0 for null texts, texts without a letter, and where nothing could be learned.
    - Rows of null lang are predicted but not learned from; a null doc_id is in the learning fold.
    - Rows that repeat a doc_id are predicted each for itself; an empty table gives no rows.
    - Other columns are ignored, whatever their names; lang, source and doc_id are no inputs.
    """
    coder = fit_languages(docs, **how)
    found = predict_columns(docs.select("doc_id", "text", held_out().alias("held_out")), coder)
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, reject_below: float = 0.0, **how) -> DataFrame:
    """The rows of docs, all columns, without those of no language: und, and scores below ``reject_below``.

    - Null, empty and blank texts go, and texts without a letter; so do all rows where nothing could be learned.
    - A null doc_id or lang is a value like others. Rows that repeat stay or go together.
    - An empty table gives no rows; other columns are kept, whatever their names.
    """
    coder = fit_languages(docs, **how)
    found = docs.select(F.struct("*").alias("row"), "text")
    found = predict_columns(found, coder).filter((F.col("lang_pred") != "und") & (F.col("score") >= reject_below))
    return found.select("row.*")
