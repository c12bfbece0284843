"""The registered queries of this subpackage: thin wrappers that read whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.decontaminate import contaminated
from codeloom.llm.exact_dedup import exact_dedup
from codeloom.llm.html_tree import extract_pages
from codeloom.llm.langid import identify_languages
from codeloom.llm.mixing import label_domains, mix_documents
from codeloom.llm.secret_scan import secret_digest
from codeloom.llm.sharding import kd_shards
from codeloom.llm.simhash import simhash_groups
from codeloom.llm.token_counts import length_histogram, token_budgets
from codeloom.llm.token_store import token_files


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Weights, by tokens, of the domains that the table of labels names: good text is not thinned out.
MIX_TARGETS = {"good": 0.93, "poor": 0.06, "toxic": 0.01}


def op1_soft_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mix_documents(docs, label_domains(_table(spark, sf_dir, "labels")), MIX_TARGETS)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(_table(spark, sf_dir, "documents"), shards=40)


def op5_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op6_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op7_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(_table(spark, sf_dir, "documents"))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_budgets(length_histogram(_table(spark, sf_dir, "documents"), tokenizer_path()))


QUERIES = {
    "op1_soft_mixture": op1_soft_mixture,
    "op2_token_files": op2_token_files,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_kd_shards": op4_kd_shards,
    "op5_style_tree": op5_style_tree,
    "op6_language_codes": op6_language_codes,
    "op7_benchmark_windows": op7_benchmark_windows,
    "op8_secret_spans": op8_secret_spans,
    "op9_simhash_groups": op9_simhash_groups,
    "op10_token_counts": op10_token_counts,
}

_RULES_SQL = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
    "code_host": (r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
}


def _secret_sql() -> str:
    """All spans from the lengths of matches and of the pieces between them; every text is matched."""
    each = []
    for k, (kind, (pattern, group, least)) in enumerate(_RULES_SQL.items()):
        each.append(f"""
            SELECT n, doc_id, {k} AS ord, '{kind}' AS kind, s AS start, s + length(w[i]) AS stop
            FROM (SELECT n, doc_id, i, w, g,
                         list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) AS s
                  FROM (SELECT n, doc_id, p, w, g, unnest(range(1, len(w) + 1)) AS i
                        FROM (SELECT n, doc_id, string_split_regex(t, '{pattern}') AS p,
                                     regexp_extract_all(t, '{pattern}', 0) AS w, regexp_extract_all(t, '{pattern}', {group}) AS g FROM d)))
            WHERE length(g[i]) >= {least}""")
    joined = "string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, ord)"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
             spans AS ({' UNION ALL '.join(each)}),
             told AS (SELECT n, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access,
                             count(*) FILTER (WHERE ord = 2) AS n_hex,
                             {joined} FILTER (WHERE ord < 3) AS base, {joined} AS spans FROM spans GROUP BY n)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN told USING (n)"""


ORACLES = {
    "op8_secret_spans": _secret_sql(),
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER w = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
    """,
}
