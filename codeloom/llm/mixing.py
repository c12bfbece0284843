"""Mixing towards target weights with soft domain membership, in DataFrame operations only.

A multinomial naive Bayes classifier over hashed words, fitted on a labelled table, gives every
document a posterior over domains. Each document gets a rate r >= 0, so that the expected tokens of
domain k, the sum of r * tokens * posterior k, match the target's share of all tokens. Rates are found
by projected gradient descent on the squared misfit; the documents' rates and posteriors stay
distributed, and a step exchanges one sum for each domain.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialize, skew_join

log = logging.getLogger("codeloom")

BUCKETS = 1 << 14  # of hashed words
QUICK = 30  # steps towards targets that rates can meet
TEMPER = 400  # words after which a document's evidence is averaged instead of added


def domain_words(text: str) -> Column:
    return F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[ \t-\r]+", -1)


def fit_domains(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, prior: float = 20_000.0
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Domains, their log shares and log word weights (BUCKETS x domains), relative to all labelled text.

    ``prior`` words of the average text are added to each domain, so that a domain of few labels does not
    take its rare words for a sign.

    docs has doc_id and text, labels has doc_id and domain. The classifier is fitted on at most
    ``max_rows`` labels, those of least hash of doc_id, which bounds what is broadcast; null domains are not
    learned from. What reaches the driver is one count for each domain and bucket.
    """
    labels = labels.filter("domain IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "domain")
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(max_rows)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Each document adds one token of bucket -1, so one pass counts words and documents.
    buckets = F.transform(F.filter(domain_words("text"), lambda w: w != ""), _bucket)
    tokens = labelled.select("domain", F.explode(F.array_append(buckets, F.lit(-1))).alias("bucket"))
    counted = tokens.groupBy("domain", "bucket").count().collect()
    domains = sorted({r["domain"] for r in counted})
    counts = np.zeros((BUCKETS, len(domains)))
    shares = np.zeros(len(domains))
    for r in counted:
        k = domains.index(r["domain"])
        if r["bucket"] < 0:
            shares[k] = r["count"]
        else:
            counts[r["bucket"], k] += r["count"]
    average = (counts.sum(axis=1) + 0.5) / (counts.sum() + 0.5 * BUCKETS)
    weights = np.log((counts + prior * average[:, None]) / (counts.sum(axis=0) + prior)) - np.log(average)[:, None]
    return domains, np.log(shares / max(shares.sum(), 1)), weights


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def posteriors(docs: DataFrame, model, key: list[str]) -> DataFrame:
    """key columns, n_tokens (words of the text) and p0, p1, ...: the posterior of each domain.

    A document without words has the domains' shares among labelled rows.
    """
    domains, log_share, relative = model
    # The weights of a domain are one literal; a document's score sums those of its words' buckets.
    tables = [F.split(F.lit(",".join(f"{x:.5f}" for x in relative[:, k])), ",").cast("array<double>") for k in range(len(domains))]
    buckets = F.transform(F.filter(domain_words("text"), lambda w: w != ""), _bucket)
    base = docs.select(*key, buckets.alias("__b")).withColumn("n_tokens", F.size("__b").cast("long"))
    scored = base.select(*key, "n_tokens", *[_lookup_sum("__b", t).alias(f"s{k}") for k, t in enumerate(tables)])
    tempered = F.greatest(F.lit(1.0), F.col("n_tokens") / F.lit(float(TEMPER)))
    logits = [F.col(f"s{k}") / tempered + F.lit(float(log_share[k])) for k in range(len(domains))]
    scored = scored.select(*key, "n_tokens", *[x.alias(f"l{k}") for k, x in enumerate(logits)])
    top = F.greatest(*[F.col(f"l{k}") for k in range(len(domains))]) if len(domains) > 1 else F.col("l0")
    exps = scored.select(*key, "n_tokens", *[F.exp(F.col(f"l{k}") - top).alias(f"e{k}") for k in range(len(domains))])
    norm = sum((F.col(f"e{k}") for k in range(1, len(domains))), F.col("e0"))
    return exps.select(*key, "n_tokens", *[(F.col(f"e{k}") / norm).alias(f"p{k}") for k in range(len(domains))])


def _lookup_sum(buckets: str, table: Column) -> Column:
    return F.aggregate(buckets, F.lit(0.0), lambda total, b: total + F.get(table, b))


def fit_rates(rows: DataFrame, targets: list[float], steps: int = 200, tolerance: float = 1e-4) -> tuple[DataFrame, list[float]]:
    """rows (n_tokens, p0, p1, ...) with a column ``rate``, and the expected tokens of each domain under these rates.

    Projected gradient descent on half the squared misfit of expected domain tokens to the targets, over rates >= 0 from a start of 1.
    First the misfit is measured in the inverse of the Gram matrix of the domains over the documents whose rate is above 0, which
    meets targets in a few steps where rates can meet them. If it has not after QUICK steps, the least misfit is looked for
    from the start in the inverse of the whole Gram matrix, in which a step of 1 never overshoots, with a run-up (Nesterov). It ends
    when every domain is within ``tolerance`` of all tokens, or five steps have not lowered the misfit, as with targets that no rates
    reach. If that has not ended after ``steps`` steps it warns; the rates are those of the last step.

    - Rows without tokens count for nothing; their rates follow from their posteriors.
    - Equal rows get equal rates. Without any token, and in an empty table, rates are 1 and nothing is expected.
    """
    k = len(targets)
    p = [F.col(f"p{i}") for i in range(k)]
    of_domain = lambda rate: [F.sum(rate * F.col("n_tokens") * p[i]).alias(f"t{i}") for i in range(k)]
    positive = F.when(F.col("rate") > 0, F.col("n_tokens"))
    of_pairs = [F.sum(positive * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]

    def sums(now: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
        """Expected tokens, Gram matrix over documents of a rate above 0, and all tokens."""
        row = now.agg(*of_domain(F.col("rate")), *of_pairs, F.sum("n_tokens").alias("all")).first()
        gram = [[float(row[f"g{i}_{j}"] or 0) for j in range(k)] for i in range(k)]
        return np.array([float(row[f"t{i}"] or 0) for i in range(k)]), np.array(gram).reshape(k, k), float(row["all"] or 0)

    inverse = lambda gram: np.linalg.pinv(gram, rcond=1e-9)
    step_of = lambda pull: sum((F.lit(float(pull[i])) * p[i] for i in range(1, k)), F.lit(float(pull[0])) * p[0])
    start = rows.withColumn("rate", F.lit(1.0))
    expected, gram, total = sums(start)
    if not total:
        return start, [0.0] * k
    goal = np.array(targets, float) / sum(targets) * total
    met = lambda x: np.abs(x - goal).max() <= tolerance * total
    now, whole = start, inverse(gram)
    for step in range(QUICK):
        if met(expected):
            return now, expected.tolist()
        now = now.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - step_of(inverse(gram) @ (expected - goal))))
        if step % 10 == 9:
            now = materialize(now, "rates")
        expected, gram, _ = sums(now)

    now = start.withColumn("before", F.col("rate"))
    best, idle, speed, passed = math.inf, 0, 1.0, None
    for step in range(steps + 1):
        expected = sums(now)[0]
        misfit = float((expected - goal) @ whole @ (expected - goal))
        idle = idle + 1 if misfit >= best * (1 - 1e-4) else 0
        if met(expected) or idle == 5:
            break
        if step == steps:
            log.warning("rates have not settled after %d steps: expected %s, wanted %s", steps, expected, goal)
            break
        # The gradient is taken ahead of the rates, in the direction of the last step; a step that did harm ends the run-up.
        if misfit > best:
            speed = 1.0
        best = min(best, misfit)
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        ahead, speed = (speed - 1) / faster if passed is not None else 0.0, faster
        pull = whole @ (expected + ahead * (expected - (expected if passed is None else passed)) - goal)
        point = F.col("rate") + F.lit(ahead) * (F.col("rate") - F.col("before"))
        now = now.withColumns({"rate": F.greatest(F.lit(0.0), point - step_of(pull)), "before": F.col("rate")})
        now, passed = materialize(now, "rates"), expected  # written, as the next step names the rate more than once
    return now.drop("before"), expected.tolist()


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of labelled documents: toxic, good (quality 1) or poor (quality 0).

    Of several labels of one document the worst counts; null labels and ids are left out.
    """
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    known = labels.select("doc_id", domain.alias("domain")).filter("domain IS NOT NULL AND doc_id IS NOT NULL")
    return known.groupBy("doc_id").agg(F.max("domain").alias("domain"))  # their names sort from good to toxic


def _mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], max_rows: int, steps: int) -> tuple[DataFrame, list[str]]:
    """doc_id, __u (hash of doc_id and text), n_tokens, p0, p1, ..., rate, copies; and the domains."""
    model = fit_domains(docs, labels, max_rows)
    domains = model[0]
    weights = [max(0.0, float(targets.get(d, 0.0))) for d in domains]
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("__u"), "text")
    if domains and sum(weights):
        rated, _ = fit_rates(materialize(posteriors(keyed, model, ["doc_id", "__u"]), "posteriors"), weights, steps)
    else:
        domains = []
        count = F.size(F.filter(domain_words("text"), lambda w: w != "")).cast("long")
        rated = keyed.select("doc_id", "__u", count.alias("n_tokens")).withColumn("rate", F.lit(1.0))
    unit = F.pmod("__u", F.lit(1 << 30)) / F.lit(float(1 << 30))
    rated = rated.withColumn("rate", F.round("rate", 6))
    return rated.withColumn("copies", F.floor(F.col("rate") + unit).cast("int")), domains


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float], max_rows: int = 20_000, steps: int = 200) -> DataFrame:
    """One row per document: doc_id, n_tokens, p_<domain> for each learned domain, rate, copies.

    ``labels`` names the domain of some doc_ids. ``targets`` are weights of domains; those that were not
    learned are ignored, and learned ones without a weight get 0. ``copies`` rounds the rate up or
    down by a hash of doc_id and text, so its expectation is the rate.

    - A null or empty text has no tokens, the labelled shares as its posterior and the rate that follows from it.
    - A null doc_id is kept. Rows that repeat get equal rates and copies.
    - With no labelled rows, or targets that sum to 0, all rates are 1. An empty table gives no rows.
    - Other columns are ignored, whatever their names.
    """
    rated, domains = _mixed(docs, labels, targets, max_rows, steps)
    own = [F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(domains)]
    return rated.select("doc_id", "n_tokens", *own, "rate", "copies")


def take_mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], max_rows: int = 20_000, steps: int = 200) -> DataFrame:
    """Rows of docs, all columns, each as often as its copies say; see ``mix_documents``.

    - A null or empty text has no tokens and stays as often as its rate says, by the hash of its doc_id.
    - A null doc_id is kept like others. Rows that repeat are each taken as often.
    - Without labels or targets every row stays once; an empty table gives no rows.
    - Other columns are kept, whatever their names: rows are packed while they are joined.
    """
    rated, _ = _mixed(docs, labels, targets, max_rows, steps)
    copies = rated.filter("copies > 0").groupBy(F.col("__u").alias("row")).agg(F.max("copies").alias("copies"), F.count("*").alias("n"))
    packed = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.struct("*").alias("doc"))
    joined = skew_join(packed, copies, "row", "n", docs.count(), F.monotonically_increasing_id())
    return joined.select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")
