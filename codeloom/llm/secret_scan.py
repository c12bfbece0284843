"""Secret scans through a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is turned into a Boolean query over trigrams that any match must
contain (in lower case, so that case never hides one). The index holds postings for the trigrams
that some query names; clauses are intersected per document, and a rule's candidates are kept
as bitmaps of a fixed size over hashed documents. A document whose bit is set is verified with
the expression itself, so a shared bit costs a look and changes nothing. Rules without
mandatory trigrams are matched against every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import hash_filter, materialize, passes, with_filter

MOST_STRINGS = 64  # of an exact set, and clauses of a query


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has ``least`` characters or more.

    Patterns hold to what Java's, Python's and RE2's syntax share.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)

Query = frozenset  # of clauses, each a frozenset of trigrams: any clause whose trigrams all occur
ANY: Query = frozenset([frozenset()])


def _either(a: Query, b: Query) -> Query:
    union = a | b
    least = frozenset(c for c in union if not any(d < c for d in union))
    return least if len(least) <= MOST_STRINGS else ANY


def _both(a: Query, b: Query) -> Query:
    pairs = frozenset(x | y for x in a for y in b)
    return _either(pairs, frozenset()) if len(pairs) <= MOST_STRINGS**2 else a


def _of_strings(strings: set[str]) -> Query:
    found: Query = frozenset()
    for s in strings:
        found = _either(found, frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]))
    return found or ANY


def _walk(parsed) -> tuple[set[str] | None, Query]:
    """The exact set of strings that a sequence matches, if it is small, and a query that holds besides."""
    exact: set[str] | None = {""}
    query = ANY
    for op, arg in parsed:
        part, more = _item(op, arg)
        query = _both(query, more)
        joined = {a + b for a in exact for b in part} if part is not None and exact is not None else None
        if joined is not None and len(joined) <= MOST_STRINGS:
            exact = joined
            continue
        if exact is not None:
            query = _both(query, _of_strings(exact))
        query = _both(query, _walk_rest(parsed, op, arg))
        return None, query
    return exact, query


def _walk_rest(parsed, op, arg) -> Query:
    """The query of what follows the item at which the exact set ended."""
    items = list(parsed)
    at = next(k for k, item in enumerate(items) if item[0] is op and item[1] is arg)
    part, more = _item(op, arg)
    first = _of_strings(part) if part is not None else more
    exact, query = _walk(items[at + 1 :])
    return _both(first, _both(query, _of_strings(exact)) if exact is not None else query)


def _item(op, arg) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is sre.IN:
        chars = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, ANY
        return (chars, ANY) if len(chars) <= 8 else (None, ANY)
    if op is sre.SUBPATTERN:
        return _walk(arg[-1])
    if op is sre.BRANCH:
        exact, query = set(), frozenset()
        for branch in arg[1]:
            own, more = _walk(branch)
            exact = exact | own if exact is not None and own is not None else None
            query = _either(query, _both(more, _of_strings(own)) if own is not None else more)
        return (exact, ANY) if exact is not None else (None, query)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = arg
        own, more = _walk(inner)
        if most == 1 and own is not None:
            return own | ({""} if least == 0 else set()), ANY
        if least == most and own is not None and least <= 4:
            power = {""}
            for _ in range(least):
                power = {a + b for a in power for b in own}
                if len(power) > MOST_STRINGS:
                    return None, ANY
            return power, ANY
        return None, ANY if least == 0 else (_both(more, _of_strings(own)) if own is not None else more)
    if op is sre.AT:
        return {""}, ANY
    return None, ANY


def trigram_query(pattern: str) -> Query:
    """Trigrams, in lower case, of which all of some clause occur in any text with a match; ANY if none must."""
    exact, query = _walk(list(sre_parser.parse(pattern)))
    query = _both(query, _of_strings(exact)) if exact is not None else query
    return ANY if frozenset() in query else query


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram and doc: which documents (by hash) hold which of the trigrams, ignoring case."""
    held = F.array_compact(F.array(*[F.when(F.col("lowered").contains(t), F.lit(t)) for t in trigrams]))
    lowered = docs.select(_key().alias("doc"), F.lower("text").alias("lowered"))
    return lowered.select("doc", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule (position in rules) and doc for documents that satisfy the rule's trigram query."""
    rows = []
    for k, rule in enumerate(rules):
        for c, clause in enumerate(sorted(map(sorted, trigram_query(rule.pattern)))):
            # A long has 62 bits to spare; documents with all of the first trigrams are a sound choice, too.
            first = clause[:62]
            rows += [(k, c, t, 1 << i, (1 << len(first)) - 1) for i, t in enumerate(first)]
    spark = docs.sparkSession
    # One row for each trigram of each clause: as many as the rules have, whatever the documents.
    clauses = spark.createDataFrame(rows, "rule int, clause int, trigram string, bit long, all_bits long")
    found = postings(docs, sorted({r[2] for r in rows})).join(F.broadcast(clauses), "trigram")
    found = found.groupBy("doc", "rule", "clause").agg(F.bit_or("bit").alias("bits"), F.first("all_bits").alias("all_bits"))
    return found.filter("bits = all_bits").select("rule", "doc").distinct()


def _bitmaps(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """One hash filter for each rule, side by side: at most 4 KB for each rule and bucket."""
    out = None
    for k in range(len(rules)):
        own = hash_filter(found.filter(F.col("rule") == k), F.col("doc"), f"m{k}")
        out = own if out is None else out.join(own, "__bucket", "full")
    return out


def _spans(rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of the rule's matches in ``text``, in code points.

    The pieces between matches and the matches themselves alternate, so their lengths add up to
    the positions.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all("text", pattern, F.lit(0))
    group = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else whole
    found = F.arrays_zip(F.split("text", rule.pattern, -1).alias("p"), whole.alias("w"), group.alias("g"))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,ord:int,end:int>>").alias("spans"))

    def step(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["w"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"))
        keep = F.coalesce(F.length(x["g"]) >= max(rule.least, 1), F.lit(False))
        return F.struct(end.alias("at"), F.when(keep, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(found, nothing, step, lambda acc: acc["spans"])


def _tight(rule: Rule) -> Rule:
    """The same matches for a pattern that ends in a greedy class: its least length put into the pattern.

    Only for whole matches: what is too short cannot hold a longer match, since it ends where
    the class ends.
    """
    if rule.group == 0 and rule.least and rule.pattern.endswith("]+"):
        literal = sre_parser.parse(rule.pattern).getwidth()[0] - 1
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least - literal},}}", 0, rule.least)
    return rule


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """doc_id, text (null as empty) and spans: array of (start, ord, end), ord being the rule's position.

    Matches of a rule are leftmost and do not overlap each other; those of several rules may.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    indexed = [r for r in rules if trigram_query(r.pattern) != ANY]
    rows = docs
    if indexed:
        found = materialize(candidates(docs, indexed), "candidates")
        rows = with_filter(docs, _key(), _bitmaps(found, indexed))
    none = F.array().cast("array<struct<start:int,ord:int,end:int>>")
    parts = []
    for order, rule in enumerate(rules):
        tight = _tight(rule)
        if rule in indexed:
            hit = passes(f"m{indexed.index(rule)}")
        else:
            hit = F.col("text").rlike(tight.pattern)
        parts.append(F.when(hit, _spans(tight, order)).otherwise(none))
    return rows.select("doc_id", "text", F.array_sort(F.concat(*parts)).alias("spans"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` lists kind:start:end of all kinds, ``base_sha256`` is the digest of those of the base
    kinds; both by start, then kind.

    - A null text counts as empty: no spans. A null doc_id is kept.
    - Rows that repeat are scanned each for itself; an empty table gives no rows.
    - Other columns are ignored, whatever their names.
    """
    rules = BASE_RULES + MORE_RULES
    names = F.array(*[F.lit(r.kind) for r in rules])
    said = lambda s: F.concat(F.element_at(names, s["ord"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])
    joined = lambda spans: F.array_join(F.transform(spans, said), ",")
    base = F.filter("spans", lambda s: s["ord"] < len(BASE_RULES))
    counted = lambda k: F.size(F.filter("spans", lambda s: s["ord"] == k)).cast("long")
    counts = [counted(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)]
    found = secret_spans(docs, rules)
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
