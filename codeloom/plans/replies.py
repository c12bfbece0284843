"""Results of an analysis as Markdown, and the seven questions that tools may ask, with the arguments they take.

A reply is a list of sections, each of a heading and lines. What is worth saying is a table of rules over the statistics: the first
column tells when, the second what. Lists are cut on the cluster, before they are collected.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.analyze import Analysis
from codeloom.sources.config import Config

# How many entries of a list are shown.
SHOWN = {"dead": 10, "groups": 5, "places": 3, "path": 20, "unused": 20, "largest": 5}

Rules = list[tuple[Callable[[dict], bool], str]]

ADVICE: Rules = [
    (lambda s: s["dead_files"] > 0, "{dead_files} unreached file(s) could be deleted."),
    (lambda s: s["long_files"] > 0, "{long_files} of the longest files have more than 500 lines and could be split."),
    (lambda s: s["reachability"] < 80, "Only {reachability}% of the files are reached from entry points."),
    (lambda s: s["entry_points"] == 0, "No entry point is known: name some in the configuration."),
    (lambda s: s["redundancy"] > 0.1 and s["cross_class"] > 0, "{cross_class} method name(s) are shared between classes."),
    (lambda s: s["dead_files"] == 0 and s["reachability"] == 100 and s["redundancy"] < 0.1, "All files are in use and few names repeat."),
    (lambda s: s["dead_files"] == 0 and s["reachability"] == 100 and s["redundancy"] >= 0.1, "All files are in use; repeated names are worth a look."),
]

STRUCTURE_ADVICE: Rules = [
    (lambda s: s["health"] >= 80, "The structure is sound."),
    (lambda s: 60 <= s["health"] < 80, "The structure is sound but for details."),
    (lambda s: s["health"] < 60, "The structure needs work."),
    (lambda s: s["connectivity"] < 25, "Most files neither import nor are imported."),
    (lambda s: s["missing"] > 0, "{missing} imported file(s) do not exist."),
    (lambda s: s["unconnected"] > 10, "{unconnected} files stand alone."),
    (lambda s: s["health"] >= 60 and s["missing"] == 0, "Every imported file exists."),
]

NAMES_ADVICE: Rules = [
    (lambda s: s["duplicate_groups"] == 0, "Every name is used once."),
    (lambda s: s["cross_class"] > 0, "{cross_class} name(s) are methods of several classes: an interface, or repeated work."),
    (lambda s: s["cross_file"] > 0, "{cross_file} name(s) are functions of several files, which might share one."),
    (lambda s: s["redundancy"] > 0.3, "Repeated names are many ({repeated}%)."),
]

FUNCTION_ADVICE: Rules = [
    (lambda s: s["total"] == 0, "No function was found; were the files read?"),
    (lambda s: s["async_functions"] > 0, "{async_functions} functions are asynchronous ({async_share}%)."),
    (lambda s: s["methods"] > s["regular"], "Most functions are methods of classes."),
    (lambda s: s["regular"] > s["methods"], "Most functions stand outside classes."),
]


def said(rules: Rules, s: dict) -> list[str]:
    return [f"- {text.format(**s)}" for holds, text in rules if holds(s)]


def markdown(title: str, sections: Iterable[tuple[str, list[str]]]) -> str:
    """A title and those sections that have lines."""
    out = [f"# {title}"]
    for heading, lines in sections:
        if lines:
            out += ["", f"## {heading}", "", *lines]
    return "\n".join([*out, ""])


def figures(**named: Any) -> list[str]:
    return [f"- {name.replace('_', ' ').capitalize()}: {value}" for name, value in named.items()]


def fixed(x: float, digits: int = 1) -> str:
    return f"{x:.{digits}f}"


def left_over(total: int, shown: int, what: str) -> list[str]:
    return [f"- {total - shown} more {what}"] if total > shown else []


def _paths(a: Analysis, df: DataFrame, most: int | None = None) -> list[str]:
    ordered = df.orderBy("path").select(a.displayed("path").alias("path"))
    return [r.path for r in (ordered if most is None else ordered.limit(most)).toLocalIterator()]


def _groups(rows: DataFrame) -> Iterable[tuple[Any, list]]:
    """Rows of ``Analysis.places`` by group, most frequent first; one group at a time is held."""
    group: list = []
    for r in rows.orderBy(F.desc("count"), "first_seen", "bare", "place").toLocalIterator():
        if group and group[0].bare != r.bare:
            yield group[0], group
            group = []
        group.append(r)
    if group:
        yield group[0], group


def _name_statistics(s: dict) -> list[str]:
    return figures(
        functions_and_methods=s["total_functions"], different_names=s["unique_names"], repeated_names=s["duplicate_groups"],
        their_places=s["total_duplicates"], redundancy=f"{fixed(s['redundancy'] * 100)}%",
    )


def report(a: Analysis, entry: str | None = None, now: datetime | None = None) -> str:
    """Everything in one page."""
    s = dict(a.stats)
    longest = a.nodes.filter("loc > 0").orderBy(F.desc("loc"), "path").limit(SHOWN["largest"])
    longest = longest.select(a.displayed("path").alias("path"), "loc").collect()
    s["long_files"] = sum(r["loc"] > 500 for r in longest)
    dead = [f"- `{p}`" for p in _paths(a, a.dead.dead_files, SHOWN["dead"])]
    groups = []
    for head, places in _groups(a.places(SHOWN["groups"], SHOWN["places"])):
        groups += [f"- {head.bare}: {head['count']} places, {head.category}", *(f"  - {r.location}" for r in places)]
        groups += ["  " + x for x in left_over(head["count"], SHOWN["places"], "places")]
    path: list[str] = []
    if entry:
        found = a.critical_path(entry)
        first = found.orderBy("position").limit(SHOWN["path"]).select(a.displayed("id").alias("path")).collect()
        path = [f"{k}. `{r.path}`" for k, r in enumerate(first, 1)] + left_over(found.count(), SHOWN["path"], "files")
        path = [f"From `{entry}`:", "", *path] if first else [f"`{entry}` leads to no file."]
    unused = "not known" if s["unused_exports"] is None else s["unused_exports"]
    imports_each = fixed(s["imports"] / s["files"] * 10 if s["files"] else 0.0)
    when = (now or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
    return markdown(f"Analysis of {a.root}", [
        ("Made", [when]),
        ("Size", figures(files=s["files"], functions=s["functions"], imports=s["imports"], exports=s["exports"], entry_points=s["entry_points"], external_packages=s["external_modules"])),
        ("Health", [f"{s['health_report']} of 100 ({s['label']})", "", *figures(reached=f"{s['reachability']}%", imports_for_ten_files=imports_each, redundancy=f"{fixed(s['redundancy'] * 100)}%")]),
        ("Reachability", figures(reached_files=f"{s['reachable_files']} of {s['total_files']}", unreached_files=s["dead_files"], unused_exports=unused)),
        ("Unreached files", dead + left_over(s["dead_files"], SHOWN["dead"], "files")),
        ("Repeated names", groups + left_over(s["duplicate_groups"], SHOWN["groups"], "names")),
        ("Longest files", [f"{k}. `{r.path}`: {r['loc']} lines" for k, r in enumerate(longest, 1)]),
        ("Way from the entry point", path),
        ("Advice", said(ADVICE, s)),
    ])


def graph_size(a: Analysis) -> str:
    s = a.stats
    nodes, links = a.graph_json()
    kinds = nodes.agg(F.count("*").alias("nodes"), F.count_if("is_entry_point").alias("entries"), F.count_if(F.col("type") == "external-module").alias("outside")).first()
    return markdown(f"Code graph of {a.root}", [
        ("Statistics", figures(files=s["files"], modules=s["modules"], functions=s["functions"], imports=s["imports"], exports=s["exports"],
                               entry_points=s["entry_points"], external_modules=s["external_modules"], triples=s["total_triples"])),
        ("Nodes and edges", figures(nodes=kinds.nodes, edges=links.count(), entry_points=kinds.entries, external_modules=kinds.outside)),
    ])


def dead_code(a: Analysis, format: str = "json") -> str:
    """Statistics and all unreached files; as ``text`` with the first unused exports, too."""
    s = a.dead.stats.first()
    sections = [
        ("Statistics", figures(files=s.total_files, reached_files=s.reachable_files, unreached_files=s.dead_files, unused_exports=s.unused_exports, reached=f"{s.reachability}%")),
        ("Unreached files", [f"- {p}" for p in _paths(a, a.dead.dead_files)] or ["All files are reached from entry points."]),
    ]
    if format == "text" and s.unused_exports:
        first = a.dead.unused_exports.orderBy("src", "name").limit(SHOWN["unused"]).select(a.displayed("src").alias("src"), "name").collect()
        sections.append(("Unused exports", [f"- {r.src}: {r['name']}" for r in first] + left_over(s.unused_exports, SHOWN["unused"], "exports")))
    return markdown(f"Dead code of {a.root}", sections)


def health(a: Analysis) -> str:
    s = a.stats | a.structure().first().asDict()
    s["unconnected"] = s["files"] - s["connected"]
    each = lambda name: fixed(s[name] / s["files"] if s["files"] else 0.0)
    return markdown(f"Health of {a.root}", [
        ("Score", [f"{s['health']} of 100 ({s['label']})"]),
        ("Parts", figures(connectivity=f"{s['connectivity']} of 50, {s['connected']} files", structure=f"{s['structure']} of 30, {each('imports')} imports and {each('exports')} exports a file",
                          quality=f"{s['quality']} of 20, {s['missing']} missing files")),
        ("Graph", figures(files=s["files"], functions=s["functions"], imports=s["imports"], exports=s["exports"], external_modules=s["external_modules"])),
        ("Connections", figures(imported_files=s["with_dependents"], importing_files=s["with_imports"], connected_files=s["connected"], unconnected_files=s["unconnected"])),
        ("Advice", said(STRUCTURE_ADVICE, s)),
    ])


def isolated(a: Analysis) -> str:
    listed = [f"- {p}" for p in _paths(a, a.dead.dead_files)]
    return markdown(f"Isolated files of {a.root}", [("Files that no entry point reaches", listed or ["There are none."])])


def hubs(a: Analysis, threshold: int = 5, limit: int = 20) -> str:
    rows = a.hubs(threshold, limit).select(a.displayed("path").alias("path"), "dependent_count", "import_count", "export_count", "tier").collect()
    listed = [f"{k}. `{r.path}` ({r.tier}): {r.dependent_count} dependents, {r.import_count} imports, {r.export_count} exports" for k, r in enumerate(rows, 1)]
    return markdown(f"Hubs of {a.root}", [
        (f"Files with {threshold} dependents and more", listed or ["There are none."]),
        ("Impact", [f"Changes to these {len(rows)} files bear on {sum(r.dependent_count for r in rows)} imports."] if rows else []),
    ])


def functions(a: Analysis, show_files: bool = False) -> str:
    from codeloom.operators.duplicates import function_stats

    row, files = function_stats(a.functions, a.nodes).first().asDict(), []
    row["async_share"] = fixed(row["async_percent"])
    if show_files:
        files = a.function_report()[1].select(a.displayed("file").alias("file"), "count").collect()
    return markdown(f"Functions of {a.root}", [
        ("Statistics", figures(functions_and_methods=row["total"], functions=row["regular"], methods=row["methods"], asynchronous=row["async_functions"],
                               static=row["static_methods"], generators=row["generators"], functions_a_file=fixed(row["per_file"]))),
        ("Files with most functions", [f"{k}. {r.file}: {r['count']}" for k, r in enumerate(files, 1)]),
        ("Remarks", said(FUNCTION_ADVICE, row)),
    ])


def duplicates(a: Analysis, similar: float | None = None) -> str:
    """All repeated names with all their places; ``similar`` adds names at least that alike."""
    from codeloom.operators.duplicates import duplicate_stats, similar_occurrences

    s = duplicate_stats(a.functions, a.groups, a.ignore_common).first().asDict()
    s["repeated"] = fixed(s["redundancy"] * 100)
    listed = []
    for head, places in _groups(a.places()):
        listed += [f"### {head.bare}: {head['count']} places, {head.category}", ""]
        listed += [f"- {r.location} ({r['name']}, {r.params} params){r.qualifiers}" for r in places] + [""]
    alike = []
    if similar is not None:
        rows = similar_occurrences(a.functions, a.similar(similar), a.ignore_common)
        for head, places in _alike(rows):
            alike += [f"### {head.a} and {head.b}: {fixed(head.similarity * 100, 0)}% alike", ""]
            alike += [f"- {r.location} ({r['name']})" for r in places] + left_over(head.total, SHOWN["places"], "places") + [""]
    return markdown(f"Repeated names of {a.root}", [
        ("Statistics", _name_statistics(s)), ("Names", listed or ["No name repeats."]), ("Names much alike", alike), ("Remarks", said(NAMES_ADVICE, s)),
    ])


def _alike(rows: DataFrame) -> Iterable[tuple[Any, list]]:
    """The first places of each pair of similar names, and their number as ``total``; most alike first."""
    from pyspark.sql import Window

    pair = Window.partitionBy("a", "b")
    rows = rows.withColumns({"k": F.row_number().over(pair.orderBy("side", "location")), "total": F.count("*").over(pair)})
    group: list = []
    for r in rows.filter(F.col("k") <= SHOWN["places"]).orderBy(F.desc("similarity"), "a", "b", "k").toLocalIterator():
        if group and (group[0].a, group[0].b) != (r.a, r.b):
            yield group[0], group
            group = []
        group.append(r)
    if group:
        yield group[0], group


def duplicates_json(a: Analysis) -> str:
    """Statistics, and all repeated names with all their places."""
    from codeloom.operators.duplicates import duplicate_stats

    stats = duplicate_stats(a.functions, a.groups, a.ignore_common).first().asDict()
    names = [{"name": h.bare, "count": h["count"], "category": h.category, "occurrences": [r.location for r in places]} for h, places in _groups(a.places())]
    return json.dumps({"stats": stats, "duplicates": names}, indent=2)


@dataclass(frozen=True)
class Argument:
    kind: type
    default: Any = None
    required: bool = False
    choices: tuple[str, ...] = ()
    about: str = ""

    def read(self, name: str, value: Any) -> Any:
        good = isinstance(value, (int, float)) and not isinstance(value, bool) if self.kind is float else isinstance(value, self.kind) and not (self.kind is int and isinstance(value, bool))
        if not good or self.choices and value not in self.choices:
            raise ValueError(f"{name}: {value!r} is no {'one of ' + ', '.join(self.choices) if self.choices else self.kind.__name__}")
        return value

    def schema(self) -> dict:
        out: dict[str, Any] = {"type": {str: "string", int: "integer", float: "number", bool: "boolean"}[self.kind], "description": self.about}
        if self.choices:
            out["enum"] = list(self.choices)
        if self.default is not None:
            out["default"] = self.default
        return out


_WHERE = {"directory": Argument(str, required=True, about="folder of the sources"), "config": Argument(str, about="configuration file")}

TOOLS: dict[str, dict[str, Argument]] = {
    "analyze": _WHERE,
    "dead_code": _WHERE | {"format": Argument(str, "json", choices=("text", "json"), about="text adds unused exports")},
    "health": _WHERE,
    "isolated": _WHERE,
    "hubs": _WHERE | {"threshold": Argument(int, 5, about="least dependents of a hub"), "limit": Argument(int, 20, about="most hubs that are listed")},
    "functions": _WHERE | {"show_files": Argument(bool, False, about="list files of most functions")},
    "duplicates": _WHERE | {
        "threshold": Argument(int, 2, about="least places of a name"), "ignore_common": Argument(bool, True, about="leave common names out"),
        "include_similar": Argument(bool, False, about="list names much alike"), "similarity": Argument(float, 0.8, about="how much alike"),
    },
}


def schemas() -> list[dict]:
    """Names and arguments of the tools as JSON schemas."""
    return [
        {"name": name, "inputSchema": {"type": "object", "properties": {k: v.schema() for k, v in given.items()}, "required": [k for k, v in given.items() if v.required]}}
        for name, given in TOOLS.items()
    ]


def answer(spark: SparkSession, tool: str, **arguments: Any) -> str:
    """The Markdown reply of a tool; ValueError for unknown tools and wrong arguments, FileNotFoundError for a folder that is not there."""
    if tool not in TOOLS:
        raise ValueError(f"unknown tool: {tool}")
    given = TOOLS[tool]
    if wrong := [k for k in arguments if k not in given] or [k for k, v in given.items() if v.required and arguments.get(k) is None]:
        raise ValueError(f"{tool}: unknown or missing arguments: {', '.join(wrong)}")
    read = {k: v.read(k, arguments[k]) if arguments.get(k) is not None else v.default for k, v in given.items()}
    names = {"threshold": read["threshold"], "ignore_common": read["ignore_common"]} if tool == "duplicates" else {}
    a = Analysis.of(spark, read.pop("directory"), Config.load(read.pop("config")), **names)
    if tool == "duplicates":
        return duplicates(a, read["similarity"] if read["include_similar"] else None)
    run = {"analyze": graph_size, "dead_code": dead_code, "health": health, "isolated": isolated, "hubs": hubs, "functions": functions}[tool]
    return run(a, **read)
