import pytest

from codeloom.functions.jsparse import ParseError, parse, tokenize


def names(text, **how):
    return [f["name"] for f in parse(text, **how).functions]


def test_imports_of_modules():
    p = parse("import a, { b as c, d } from './x.js'\nimport * as n from 'pkg'\nimport 'side'\nimport e from \"@s/p\";\n")
    assert [(i["source"], i["specifiers"], i["line"]) for i in p.imports] == [
        ("./x.js", ["default", "b", "d"], 1), ("pkg", ["*"], 2), ("side", ["*"], 3), ("@s/p", ["default"], 4),
    ]


def test_requires_and_calls():
    p = parse("const a = require('fs'), b = require(name)\nfoo(1)\nobj.bar()\nnew Thing()\nif (x) baz()")
    assert [(i["source"], i["dynamic"]) for i in p.imports] == [("fs", False), (None, True)]
    assert [c["function"] for c in p.calls] == ["require", "require", "foo", "baz"]


def test_exports():
    p = parse(
        "export const x = 1\nexport function f() {}\nexport class C { m() {} }\nexport default 5\nexport { x as y, f }\n"
        "export * from './all'\nexport { q } from './q'\nexport * as ns from './ns'\nmodule.exports = 1\nexports.z = 2\nmodule.exports.w = 3\nexports['k'] = 4\n"
    )
    assert [(e["type"], e.get("specifiers"), e.get("property")) for e in p.exports] == [
        ("named", [], None), ("named", [], None), ("named", [], None), ("default", ["default"], None), ("named", ["y", "f"], None),
        ("all", None, None), ("named", ["q"], None), ("named", ["ns"], None), ("commonjs", None, None), ("commonjs", None, "z"), ("commonjs", None, None),
    ]
    assert [(i["type"], i["source"]) for i in p.imports] == [("import", "./all"), ("import", "./q"), ("import", "./ns")]


def test_functions_and_methods():
    p = parse(
        "async function go(a, {b, c} = {}, ...rest) {}\nfunction* gen() {}\nconst arrow = () => {}\nconst e = function named() {}\n"
        "class A extends B.C {\n  static count = 0\n  name = 'x'\n  constructor(a) { super(a) }\n  get v() { return 1 }\n  static async make(x, y,) {}\n"
        "  *items() {}\n  #hidden() {}\n  'quoted'() {}\n  handler = () => { go() }\n  get(k) { return k }\n}\n"
        "export default class { run() {} }\nconst k = class { no() {} }\nconst o = { method() {}, f: function () {} }\n"
    )
    assert [(f["name"], f["params"], f["line"]) for f in p.functions] == [
        ("go", 3, 1), ("gen", 0, 2), ("A.constructor", 1, 8), ("A.v", 0, 9), ("A.make", 2, 10), ("A.items", 0, 11),
        ("A.quoted", 0, 13), ("A.get", 1, 15), ("AnonymousClass.run", 0, 17),
    ]
    flags = {f["name"]: f for f in p.functions}
    assert flags["go"]["is_async"] and flags["gen"]["is_generator"] and flags["A.make"]["is_static"] and flags["A.v"]["kind"] == "get"


def test_text_that_only_looks_like_code():
    text = "// import x from 'no'\n/* require('no') */\nconst s = \"import y from 'no'\", r = /require('no')[/]/g, t = `a ${f(`b ${require('yes')}`)} import z from 'no'`\n"
    assert [i["source"] for i in parse(text).imports] == ["yes"]
    assert names("const a = b / c / d\nfunction f() {}\nif (x) /re(/.test(y)\nfunction g() {}") == ["f", "g"]


def test_dynamic_imports_only_on_request():
    text = "const m = await import('./lazy.js')"
    assert parse(text).imports == []
    assert [i["type"] for i in parse(text, dynamic_imports=True).imports] == ["dynamic-import"]


@pytest.mark.parametrize("text", ["function f( {", "const s = 'open", "a)", "`${x", "/* open", "/re"])
def test_broken_texts(text):
    with pytest.raises(ParseError):
        parse(text)


def test_odd_texts():
    assert parse("").functions == [] and parse("#!/usr/bin/env node\nfunction f(){}").functions[0]["line"] == 2
    assert [t.text for t in tokenize("a\n=> b")][:2] == ["a", "=>"]
    assert names("export default function () {}\nexport default async function named() {}") == ["named"]
