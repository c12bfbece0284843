"""Exact histogram of encoded lengths, and the token budgets it answers for any context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialize, running_total
from codeloom.llm.tokenizing import encoder


def length_histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """n_tokens and n_docs: how many documents have each encoded length.

    Null and empty texts have length 0; repeated rows count each time; an empty table gives no
    rows. Other columns are ignored, whatever their names.
    """

    def lengths(batches):
        words = encoder(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(words.encode(t)) // words.dtype.itemsize for t in batch["text"].to_pylist()], pa.int64())], ["n_tokens"]
            )

    texts = docs.select(F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(lengths, "n_tokens long").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def token_budgets(histogram: DataFrame) -> DataFrame:
    """Per length L of the histogram what the suffix sums say about a context limit of L tokens.

    n_tokens (L), n_docs, docs_longer and tokens_longer (documents over L and their tokens),
    docs_total, tokens_total, tokens_truncated (sum of min(length, L)), tokens_lost (cut off at L),
    quantile (share of documents of at most L tokens).
    """
    # As many rows as there are distinct lengths, so a few files hold them at any scale.
    base = materialize(histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).coalesce(8), "histogram")
    sums = running_total(base, "n_tokens", "n_docs", "docs_longer", descending=True)
    sums = running_total(sums, "n_tokens", "tokens", "tokens_longer", descending=True)
    docs_total, tokens_total = base.agg(F.sum("n_docs"), F.sum("tokens")).first()
    sums = sums.withColumns({"docs_total": F.lit(docs_total).cast("long"), "tokens_total": F.lit(tokens_total).cast("long")})
    kept = F.col("tokens_total") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")
    return sums.select(
        "n_tokens", "n_docs", "docs_longer", "tokens_longer", "docs_total", "tokens_total",
        kept.alias("tokens_truncated"),
        (F.col("tokens_total") - kept).alias("tokens_lost"),
        ((F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")).alias("quantile"),
    )


def budget_at(budgets: DataFrame, limit: int) -> dict:
    """Answers for one limit, also between two lengths: documents and tokens over it, total after truncation."""
    row = budgets.filter(F.col("n_tokens") > limit).agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs_longer"),
        F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)).alias("tokens_longer"),
    )
    found = row.first().asDict()
    total = budgets.agg(F.max("tokens_total")).first()[0] or 0
    return found | {"tokens_truncated": total - found["tokens_longer"] + found["docs_longer"] * limit}
