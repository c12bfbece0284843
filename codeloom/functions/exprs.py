"""Scalar expressions over code-graph values; all of them plain Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix of the ids of bare names; a parameter of node_id for graphs that use another one.
NAME_PREFIX = "urn:code:"

# Names too common to report as duplicates. Two of them have capitals and so never match a lowered name.
COMMON_NAMES = (
    "constructor", "render", "init", "initialize", "setup", "destroy", "toString", "valueOf",
    "get", "set", "update", "create", "delete", "handle", "process", "execute",
)

# Paths that are entry points by their look.
ENTRY_PATTERNS = (
    r"/bin/",
    r"/scripts?/",
    r"server\.js$",
    r"main\.js$",
    r"app\.js$",
    r"index\.js$",
    r"\.config\.(js|mjs|cjs|ts)$",
    r"(?i:/(tests?|specs?|__tests__|__specs__)/)",
    r"\.(test|spec)\.(js|mjs|cjs|ts)$",
)

# Source extensions that are scanned.
EXTENSIONS = (".js", ".mjs", ".cjs", ".jsx")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def node_id(x: str | Column, prefix: str = NAME_PREFIX) -> Column:
    """Graph id of a path, URL or bare name."""
    x = _c(x)
    return (
        F.when(x.startswith("/"), F.concat(F.lit("file://"), x))
        .when(x.contains(":"), x)
        .otherwise(F.concat(F.lit(prefix), F.replace(x, F.lit("/"), F.lit(":"))))
    )


def extension(path: str | Column) -> Column:
    """Extension with its dot as path libraries have it: empty for dotfiles and names without one."""
    return F.regexp_extract(_c(path), r"[^/]+(\.[^./]*)$", 1)


def is_source(path: str | Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def normalise_path(path: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` segments."""
    step = lambda acc, s: (
        F.when((s == "") | (s == "."), acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s))
    )
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def is_relative(source: str | Column) -> Column:
    return F.coalesce(_c(source).rlike(r"^[./]"), F.lit(False))


def is_external(source: str | Column) -> Column:
    """True for sources that name a package; null and empty ones do not."""
    source = _c(source)
    return F.coalesce((source != "") & ~source.rlike(r"^[./]"), F.lit(False))


def resolve_import(source: str | Column, from_path: str | Column) -> Column:
    """Absolute path of a relative import, ``.js`` added where the last segment has no extension; packages stay."""
    source, folder = _c(source), F.regexp_replace(_c(from_path), r"/[^/]*$", "")
    joined = normalise_path(F.when(source.startswith("/"), source).otherwise(F.concat(folder, F.lit("/"), source)))
    full = F.when(extension(joined) == "", F.concat(joined, F.lit(".js"))).otherwise(joined)
    return F.when(is_relative(source), full).otherwise(source)


def bare_name(full: str | Column) -> Column:
    """What follows the last dot."""
    return F.element_at(F.split(_c(full), r"\."), -1)


def local_name(iri: str | Column) -> Column:
    """What follows the last ``#`` or ``/``."""
    return F.regexp_extract(_c(iri), r"[^#/]*$", 0)


def last_segment(path: str | Column) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def display_path(node: str | Column, root: str = "") -> Column:
    """A file id as a path, ``./`` for what lies under root."""
    plain = F.regexp_replace(_c(node), r"^file://", "")
    return F.when(plain.startswith(root), F.concat(F.lit("."), F.substring(plain, len(root) + 1, 1 << 30))).otherwise(plain) if root else plain


def similarity(a: str | Column, b: str | Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty names."""
    a, b = _c(a), _c(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise((longest - F.levenshtein(a, b)) / longest)


def is_common_name(bare: str | Column) -> Column:
    return F.lower(_c(bare)).isin(*COMMON_NAMES)


def looks_like_entry(path: str | Column, more: tuple[str, ...] = ()) -> Column:
    return F.regexp_replace(_c(path), r"^file://", "").rlike("|".join(f"(?:{p})" for p in ENTRY_PATTERNS + tuple(more)))


#: White space of any script and byte-order marks, as trimming of lines takes them; without the line feed.
_BLANK = r"\t\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def lines_of_code(text: str | Column) -> Column:
    """Lines that are neither blank nor begin like a comment (``//``, ``/*``, ``*``), by one expression over the text."""
    line = rf"(?:\A|\n)[{_BLANK}]*(?!//|/\*|\*)[^{_BLANK}\n]"
    return F.coalesce(F.regexp_count(_c(text), F.lit(line)), F.lit(0))


def int_or_zero(x: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(_c(x).cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def truthy(x: str | Column) -> Column:
    return F.coalesce(_c(x).cast("string") == "true", F.lit(False))


def iso_time(x: str | Column) -> Column:
    return F.date_format(_c(x), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def rounded(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5).cast("long")


def node_radius(kind: Column, missing: Column, size: Column) -> Column:
    """A node's radius by kind and bytes."""
    size = F.coalesce(size, F.lit(0))
    out = F.when(kind == "external-module", 5).when(F.coalesce(missing, F.lit(False)), 14).when(size == 0, 6)
    for below, radius in ((1000, 8), (5000, 11), (10000, 14), (25000, 18), (50000, 23), (100000, 28), (200000, 34)):
        out = out.when(size < below, radius)
    return out.otherwise(40)


def node_colour(kind: Column, error: Column, dead: Column, size: Column, dependents: Column, imports: Column) -> Column:
    """A node's colour; the first rule that holds counts."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    no = lambda c: F.coalesce(c, F.lit(False))
    rules = (
        (kind == "external-module", "#a78bfa"),
        (no(error), "#dc2626"),
        (no(dead), "#6b7280"),
        ((zero(size) > 25000) & (zero(dependents) < 3), "#f97316"),
        (zero(dependents) > 10, "#4ade80"),
        (zero(dependents) > 5, "#86efac"),
        (zero(dependents) == 0, "#60a5fa"),
        (zero(imports) > 10, "#fb923c"),
        (zero(imports) > 5, "#fbbf24"),
    )
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return out.otherwise("#4a9eff")


def health_label(score: Column) -> Column:
    return F.when(score >= 80, "Excellent").when(score >= 60, "Good").when(score >= 40, "Fair").otherwise("Poor")


def hub_tier(dependents: Column) -> Column:
    return F.when(dependents > 10, "Major").otherwise("Medium")


def location(file: Column, line: Column) -> Column:
    """``file:line``; ``?`` for no line, ``unknown`` for no file."""
    has = file.isNotNull() & (file != "")
    return F.when(has, F.concat(file, F.lit(":"), F.when(line > 0, line.cast("string")).otherwise("?"))).otherwise("unknown")


def category_mark(category: str | Column) -> Column:
    """The mark of a category of duplicates in short lists."""
    marks = {"cross-class": "\U0001f504", "cross-file": "\U0001f4c1"}
    out = F.lit("\u26a0\ufe0f")
    for name, mark in marks.items():
        out = F.when(_c(category) == name, mark).otherwise(out)
    return out


def fixed_point(x: str | Column, digits: int) -> Column:
    """A number with so many digits, as text; of the exact binary value, halves away from zero."""
    return F.round(_c(x).cast("double").cast("decimal(38,18)"), digits).cast(f"decimal(38,{digits})").cast("string")


def qualifiers(is_async: Column, is_static: Column) -> Column:
    parts = F.array_compact(F.array(F.when(is_async, F.lit("async")), F.when(is_static, F.lit("static"))))
    return F.when(F.size(parts) > 0, F.concat(F.lit(" ["), F.array_join(parts, ", "), F.lit("]"))).otherwise("")
