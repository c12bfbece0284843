"""The code graph: typed node and edge tables from parsed relations, and the triple view over them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.functions import exprs as X
from codeloom.tables import written

#: Namespaces of the triple view; pass others to ``quads`` for graphs that use them.
NAMESPACES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "graph": "urn:codeloom:graph#",
    "code": "urn:codeloom:code#",
}


def edges(imports: DataFrame) -> DataFrame:
    """Distinct (src, dst) of import statements, with the order of the first statement where there is one."""
    if "seq" in imports.columns:
        return imports.groupBy("src", "dst").agg(F.min("seq").alias("first_seq"))
    return imports.select("src", "dst").distinct()


def resolved_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Internal imports with ``exists``: whether the target was scanned."""
    known = files.select(F.col("path").alias("dst"), F.lit(True).alias("exists"))
    return imports.filter(~F.col("is_external")).join(known, "dst", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def missing_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Targets of internal imports that were not scanned."""
    targets = imports.filter(~F.col("is_external")).select(F.col("dst").alias("path")).distinct()
    return targets.join(files.select("path"), "path", "left_anti")


def file_nodes(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Scanned files and missing targets: path, size, loc, parse_error, is_missing."""
    scanned = files.select("path", "size", "loc", "parse_error", F.lit(False).alias("is_missing"))
    missing = missing_files(imports, files).select(
        "path", F.lit(0).cast("long").alias("size"), F.lit(0).alias("loc"), F.lit(False).alias("parse_error"), F.lit(True).alias("is_missing")
    )
    return scanned.unionByName(missing)


def external_modules(imports: DataFrame) -> DataFrame:
    return imports.filter("is_external").select(F.col("dst").alias("id")).distinct()


def export_nodes(exports: DataFrame) -> DataFrame:
    """One node for each exported name of a file; the last statement's type and line count."""
    order = F.col("seq") if "seq" in exports.columns else F.col("line")
    return exports.groupBy("src", "name").agg(
        F.max_by("export_type", order).alias("export_type"), F.max_by("line", order).alias("line")
    ).select("src", export_id().alias("export_id"), "name", "export_type", "line")


FUNCTION_ATTRIBUTES = ("name", "type", "file", "line", "params", "is_async", "is_generator", "is_static", "kind", "class_name", "method_name")


def function_nodes(functions: DataFrame) -> DataFrame:
    """One node for each file and full name (id), where it was first seen (seq), and its attributes.

    Per attribute the distinct value that appeared last counts. A value that appears again does not become the last
    one: sets keep the first place of a member.
    """
    ided = functions.withColumn("id", F.concat_ws("#", "file", "name"))
    rows = ided.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", *FUNCTION_ATTRIBUTES))).alias("rows"))
    out = {"seq": F.get("rows", F.lit(0))["seq"]}
    for a in FUNCTION_ATTRIBUTES:
        values = F.array_distinct(F.array_compact(F.col(f"rows.{a}")))
        out[a] = F.get(values, F.size(values) - 1)
    return rows.select("id", *[c.alias(name) for name, c in out.items()])


def node_metrics(nodes: DataFrame, links: DataFrame, exported: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """File nodes with import_count, dependent_count, export_count and is_entry_point.

    Dependents are counted over files only, as only they import; all counts are pre-aggregated.
    """
    own = lambda df, key, name: df.groupBy(F.col(key).alias("path")).agg(F.count("*").alias(name))
    out = nodes.join(own(links, "src", "import_count"), "path", "left").join(own(links, "dst", "dependent_count"), "path", "left")
    out = out.join(own(exported, "src", "export_count"), "path", "left").na.fill(0, ["import_count", "dependent_count", "export_count"])
    if entries is None:
        return out.withColumn("is_entry_point", F.lit(False))
    flag = entries.select(F.col("id").alias("path"), F.lit(True).alias("is_entry_point")).distinct()
    return out.join(flag, "path", "left").na.fill(False, ["is_entry_point"])


def property_graph(metrics: DataFrame, modules: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (files and external modules) and edges as they are exported."""
    files = metrics.withColumns({"type": F.lit("file"), "is_external": F.lit(False)}).withColumnRenamed("path", "id")
    outside = modules.select("id", F.lit("external-module").alias("type"), F.lit(True).alias("is_external"))
    nodes = files.unionByName(outside, allowMissingColumns=True)
    return nodes, links.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.lit("imports").alias("type"))


def two_cycles(links: DataFrame) -> DataFrame:
    """Pairs a < b that import each other."""
    back = links.select(F.col("src").alias("b"), F.col("dst").alias("a"))
    return links.select(F.col("src").alias("a"), F.col("dst").alias("b")).filter("a < b").join(back, ["a", "b"]).distinct()


@dataclass(frozen=True)
class Triple:
    """A kind of triple that the rows of a relation make: an object for each row (``o``), or one for each of an array's values."""

    s: Column
    p: str
    o: Column
    constant: str | None = None  # the object where it is always the same
    datatype: str | None = None  # of literals
    values: Column | None = None

    def rows(self) -> Column:
        made = lambda o: F.struct(
            self.s.alias("s"), F.lit(self.p).alias("p"), o.cast("string").alias("o"),
            F.lit("iri" if self.datatype is None else "literal").alias("o_kind"), F.lit(self.datatype or "").alias("o_dt"),
        )
        return F.array(made(self.o)) if self.values is None else F.transform(self.values, made)

    def count(self) -> Column:
        return F.lit(1) if self.values is None else F.size(self.values)

    def property(self) -> str:
        """Local name of the predicate, as ``exprs.local_name`` has it."""
        return re.search(r"[^#/]*$", self.p).group()

    def present(self) -> Column:
        """Whether a row before gathering makes this triple, its object then being ``o``."""
        return F.lit(True) if self.values is None else self.o.isNotNull()


@dataclass(eq=False)
class Described:
    """Rows before gathering that describe the node ``s``: one value at most of each property."""

    df: DataFrame
    s: Column
    kinds: dict[str, list[Triple]]

    def value(self, name: str) -> Column:
        """A property's value in a struct, as values may be null; null without the property."""
        found = [F.when(k.present(), F.struct(k.o.cast("string").alias("value"))) for k in self.kinds[name]]
        return found[0] if len(found) == 1 else F.greatest(*found)

    def told(self, name: str) -> tuple[Column, Column]:
        """Whether there is a value, which may be null, and the value."""
        if len(self.kinds[name]) == 1:
            return self.kinds[name][0].present(), self.kinds[name][0].o.cast("string")
        return self.value(name).isNotNull(), self.value(name)["value"]


#: Rows of 64 bits in the filter of repeated nodes, which is broadcast.
FILTER_ROWS = 1 << 17


def _metadata_of(described: list[Described]) -> DataFrame:
    """node, property, value of nodes that may be described by several rows, of one relation or of several.

    What is shuffled for all rows is a hash of the node. Nodes whose hash is met once are described by one row, and that row's values are
    theirs; only rows of other nodes, and the few that a filter of fixed size takes for such, are brought together.
    """
    names = sorted({name for d in described for name in d.kinds})
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    if len(names) == 1:
        rows = union([d.df.select(d.s.alias("node"), d.value(names[0]).alias("t")) for d in described]).filter("t IS NOT NULL")
        return rows.groupBy("node").agg(F.max("t.value").alias("value")).select("node", F.lit(names[0]).alias("property"), "value")

    def told(df: DataFrame, values: dict[str, tuple[Column, Column]]) -> DataFrame:
        pairs = [F.when(present, F.struct(F.lit(name).alias("property"), o.alias("value"))) for name, (present, o) in values.items()]
        return df.select("node", F.explode(F.array(*pairs)).alias("t")).filter("t IS NOT NULL").select("node", "t.*")

    bucket, bit = F.shiftright("hash", 6).bitwiseAND(F.lit(FILTER_ROWS - 1)), F.expr("shiftleft(1L, cast(hash & 63 AS int))")
    hashes = union([d.df.select(F.xxhash64(d.s).alias("hash")) for d in described])
    repeated = hashes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    bits = written(repeated.groupBy(bucket.alias("bucket")).agg(F.bit_or(bit).alias("bits")), "repeated")
    alone, more = [], []
    for d in described:
        rows = d.df.withColumn("node", d.s).withColumn("hash", F.xxhash64("node")).withColumn("bucket", bucket)
        rows = rows.join(F.broadcast(bits), "bucket", "left").withColumn("repeated", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False)))
        alone.append(told(rows.filter("NOT repeated"), {name: d.told(name) for name in d.kinds}))
        none = F.lit(None).cast("struct<value:string>")
        more.append(rows.filter("repeated").select("node", *[(d.value(name) if name in d.kinds else none).alias(name) for name in names]))
    gathered = union(more).groupBy("node").agg(*[F.max(name).alias(name) for name in names])
    return union([*alone, told(gathered, {name: (F.col(name).isNotNull(), F.col(name)["value"]) for name in names})])


@dataclass
class Facts:
    """The graph as relations of one row for each node or edge, with the kinds of triples that these make.

    Values of an attribute are gathered in a set for each node or edge before any triple is made, so the triples are distinct
    without another look at them, and a pattern builds only the kinds that it can match.
    """

    parts: list[tuple[DataFrame, list[Triple]]]
    namespaces: dict[str, str]
    stated: list[tuple[DataFrame, list[Triple]]]  # the parts before gathering

    def triples(self, p: str | None = None, o: str | None = None) -> DataFrame:
        """s, p, o, o_kind (iri or literal), o_dt (datatype of literals); of one predicate and, of constant objects, one object."""
        found = None
        for df, kinds in self.parts:
            wanted = [k for k in kinds if p in (None, k.p) and (o is None or k.constant in (None, o))]
            if wanted:
                rows = df.select(F.explode(F.concat(*[k.rows() for k in wanted])).alias("t")).select("t.*")
                found = rows if found is None else found.unionByName(rows)
        if found is None:
            raise ValueError(f"no triple has the predicate {p}")
        return found

    def metadata(self) -> DataFrame:
        """``metadata`` of all triples, from the relations themselves: no triple is made before its value is known to count."""
        described: list[Described] = []
        for (df, kinds), (own, _) in zip(self.parts, self.stated):
            distinct = written(own, "named") if own is df else own  # read several times
            subjects: dict[int, Described] = {}
            for k in kinds:
                d = subjects.setdefault(id(k.s), Described(distinct, k.s, {}))
                d.kinds.setdefault(k.property(), []).append(k)
            described += subjects.values()
        groups: list[list[Described]] = []  # relations of one group share properties, those of different groups none
        for d in described:
            near = [g for g in groups if any(d.kinds.keys() & x.kinds.keys() for x in g)]
            groups = [g for g in groups if g not in near] + [[d, *(x for g in near for x in g)]]
        return reduce(DataFrame.unionByName, map(_metadata_of, groups))

    def stats(self) -> DataFrame:
        """One row of ten counters, without making a triple."""
        N = self.namespaces
        of_type = lambda kind: lambda t: (t.p, t.constant) == (N["rdf"] + "type", N["graph"] + kind)
        named = lambda name: lambda t: t.p == N["graph"] + name
        counters = {
            "total_triples": lambda t: True, "files": of_type("File"), "modules": of_type("Module"), "functions": of_type("Function"),
            "classes": of_type("Class"), "imports": named("imports"), "exports": named("exports"), "calls": named("calls"),
            "entry_points": named("isEntryPoint"), "external_modules": named("isExternal"),
        }
        rows = None
        for df, kinds in self.parts:
            sums = [F.coalesce(F.sum(sum((k.count() for k in kinds if counts(k)), F.lit(0)).cast("long")), F.lit(0)).alias(n) for n, counts in counters.items()]
            row = df.agg(*sums)
            rows = row if rows is None else rows.unionByName(row)
        return rows.agg(*[F.sum(n).alias(n) for n in counters])


def facts(
    files: DataFrame, imports: DataFrame, exports: DataFrame, functions: DataFrame, entries: DataFrame, namespaces: dict[str, str] = NAMESPACES,
    calls: DataFrame | None = None, classes: DataFrame | None = None, references: DataFrame | None = None,
) -> Facts:
    """The graph's facts. Attributes that are null, zero or empty make no triple, except flags and parameter counts.

    Optional: ``modified`` (timestamp) and ``parse_error_message`` of files, ``loc`` and ``complexity`` of functions, and relations that
    the parser does not make: calls (caller, callee, line), classes (id, name, loc), references (src, dst).
    """
    N = namespaces
    type_ = N["rdf"] + "type"
    graph, code = (lambda x: N["graph"] + x), (lambda x: N["code"] + x)

    def a(s: Column, kind: str) -> Triple:
        return Triple(s, type_, F.lit(graph(kind)), constant=graph(kind))

    def link(s: Column, p: str, o: Column) -> Triple:
        return Triple(s, p, o)

    def flag(s: Column, name: str) -> Triple:
        return Triple(s, graph(name), F.lit("true"), constant="true", datatype="boolean")

    def values(s: Column, p: str, name: str, datatype: str = "string") -> Triple:
        return Triple(s, p, F.col(name), datatype=datatype, values=F.col(name))

    def gathered(df: DataFrame, keys: list[str], numbers=(), texts=(), flags=()) -> tuple[DataFrame, DataFrame]:
        """One row for each key, with the set of present values of each attribute that the relation has; and the rows before."""
        own = {c: F.when(F.col(c) != 0, F.col(c)) for c in numbers if c in df.columns}
        own |= {c: F.when(F.col(c) != "", F.col(c)) for c in texts if c in df.columns}
        own |= {c: F.col(c) for c in flags if c in df.columns}
        sets = [F.collect_set(value).alias(c) for c, value in own.items()]
        stated = df.select(*keys, *[value.alias(c) for c, value in own.items()])
        return df.groupBy(*keys).agg(*sets) if own else stated.distinct(), stated

    parts, stated = [], []

    def part(rows: tuple[DataFrame, DataFrame] | DataFrame, kinds: list[Triple]) -> None:
        after, before = rows if isinstance(rows, tuple) else (rows, rows)
        parts.append((after, kinds))
        stated.append((before, kinds))

    def of(df: DataFrame, s: Column, named: dict[str, tuple[str, str]]) -> list[Triple]:
        return [values(s, p, name, datatype) for name, (p, datatype) in named.items() if name in df.columns]

    path, src, dst, node = (X.node_id(c) for c in ("path", "src", "dst", "id"))
    if "modified" in files.columns:
        files = files.withColumn("modified", X.iso_time("modified"))
    scanned = gathered(files, ["path"], ["size", "loc"], ["modified", "parse_error_message"], ["parse_error"])
    attributes = {
        "size": (code("size"), "integer"), "modified": (code("lastModified"), "string"), "loc": (code("loc"), "integer"),
        "parse_error": (graph("parseError"), "boolean"), "parse_error_message": (graph("parseErrorMessage"), "string"),
    }
    part(scanned, [a(path, "File"), *of(scanned[0], path, attributes)])
    part(missing_files(imports, files), [a(path, "File"), flag(path, "isMissing")])
    part(external_modules(imports), [a(node, "Module"), flag(node, "isExternal")])

    links = gathered(imports, ["src", "dst"], ["line"], ["type"])
    edge = X.node_id(F.concat("src", F.lit("-imports-"), "dst"))
    described = of(links[0], edge, {"line": (code("line"), "integer"), "type": (graph("importType"), "string")})
    part(links, [link(src, graph("imports"), dst), a(edge, "Import"), link(edge, graph("from"), src), link(edge, graph("to"), dst), *described])

    exported = gathered(exports, ["src", "name"], ["line"], ["export_type"])
    export, label = X.node_id(export_id()), F.when(F.col("name") != "", F.array("name")).otherwise(F.array().cast("array<string>"))
    described = of(exported[0], export, {"export_type": (graph("exportType"), "string"), "line": (code("line"), "integer")})
    part(exported, [link(src, graph("exports"), export), Triple(export, N["rdfs"] + "label", F.get(label, F.lit(0)), datatype="string", values=label), *described])

    told = gathered(
        functions.withColumn("id", F.concat_ws("#", "file", "name")), ["id"], ["line", "loc", "complexity"],
        ["name", "type", "file", "kind", "class_name", "method_name"], ["params", "is_async", "is_generator", "is_static"],
    )
    attributes = {
        "name": (N["rdfs"] + "label", "string"), "loc": (code("loc"), "integer"), "complexity": (code("complexity"), "integer"),
        "type": (graph("functionType"), "string"), "file": (graph("file"), "string"), "line": (code("line"), "integer"),
        "params": (graph("params"), "integer"), "is_async": (graph("async"), "boolean"), "is_generator": (graph("generator"), "boolean"),
        "is_static": (graph("static"), "boolean"), "kind": (graph("kind"), "string"), "class_name": (graph("className"), "string"),
        "method_name": (graph("methodName"), "string"),
    }
    part(told, [a(node, "Function"), *of(told[0], node, attributes)])
    part(entries.select("id").distinct(), [flag(node, "isEntryPoint")])

    if calls is not None:
        made, said = gathered(calls, ["caller", "callee"], ["line"])
        caller, callee = X.node_id("caller"), X.node_id("callee")
        call = X.node_id(F.concat("caller", F.lit("-calls-"), "callee"))
        part((made, said), [link(caller, graph("calls"), callee)])
        # Only calls with a line are nodes.
        called = [a(call, "Call"), link(call, graph("from"), caller), link(call, graph("to"), callee), values(call, code("line"), "line", "integer")]
        part((made.filter(F.size("line") > 0), said.filter("line IS NOT NULL")), called)
    if classes is not None:
        made = gathered(classes, ["id"], ["loc"], ["name"])
        part(made, [a(node, "Class"), *of(made[0], node, {"name": (N["rdfs"] + "label", "string"), "loc": (code("loc"), "integer")})])
    if references is not None:
        part(references.select("src", "dst").distinct(), [link(src, graph("references"), dst)])
    return Facts(parts, N, stated)


def export_id(src: str = "src", name: str = "name") -> Column:
    return F.concat(src, F.lit("#export:"), name)


def quads(files: DataFrame, imports: DataFrame, exports: DataFrame, functions: DataFrame, entries: DataFrame, **more) -> DataFrame:
    """The graph as distinct triples: s, p, o, o_kind (iri or literal), o_dt (datatype of literals); see ``facts``."""
    return facts(files, imports, exports, functions, entries, **more).triples()


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples of a pattern; None matches anything."""
    for column, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.filter(F.col(column) == value)
    return triples


def nodes_of_type(known: Facts, kind: str) -> DataFrame:
    """id of the nodes of a class: file, module, function, class, import, call."""
    N = known.namespaces
    return known.triples(p=N["rdf"] + "type", o=N["graph"] + kind[:1].upper() + kind[1:]).select(F.col("s").alias("id"))


def node_triples(triples: DataFrame, path: str) -> DataFrame:
    """Triples of one node, given by its path, name or id."""
    one = triples.sparkSession.range(1).select(X.node_id(F.lit(path)).alias("s"))
    return triples.join(F.broadcast(one), "s", "left_semi")  # one row


def metadata(triples: DataFrame) -> DataFrame:
    """node, property (local name), value: of several values the greatest by seq, or by value, counts."""
    order = F.struct("seq", "o") if "seq" in triples.columns else F.col("o")
    named = triples.withColumn("property", X.local_name("p"))
    return named.groupBy(F.col("s").alias("node"), "property").agg(F.max_by("o", order).alias("value"))


def ntriples(triples: DataFrame) -> DataFrame:
    """One line of N-Triples for each triple (column value); literals are escaped."""
    escaped = F.col("o")
    for raw, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(code))
    datatype = F.when(F.col("o_dt").isin("integer", "boolean"), F.concat(F.lit("^^<http://www.w3.org/2001/XMLSchema#"), "o_dt", F.lit(">"))).otherwise("")
    target = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), escaped, F.lit('"'), datatype))
    return triples.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), target, F.lit(" .")).alias("value"))


def hubs(metrics: DataFrame, threshold: int = 5, limit: int = 20) -> DataFrame:
    """Scanned files of at least so many dependents, most first, ties by path."""
    found = metrics.filter(~F.col("is_missing") & (F.col("dependent_count") >= threshold))
    top = found.orderBy(F.desc("dependent_count"), "path").limit(limit)
    return top.select("path", "dependent_count", "import_count", "export_count", X.hub_tier(F.col("dependent_count")).alias("tier"))


def last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of greatest seq of each key."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))).filter("n = 1").drop("n")
