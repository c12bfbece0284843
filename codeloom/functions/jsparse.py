"""A shallow reader of JavaScript: imports, exports, calls and functions of one source text.

A tokenizer tells strings, templates, regular expressions and comments apart; a recogniser walks
the tokens once and follows declarations, statements and classes without building a tree. What it
does not look for: arrow functions, function expressions, object methods, class expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Words and marks of the language.
KEYWORDS_BEFORE_REGEX = frozenset(
    "return typeof instanceof in of new delete void throw case do else yield await default extends".split()
)
SPACE = re.compile(r"[\s\ufeff]+")
WORD = re.compile(r"[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*|\\u[0-9a-fA-F]{4}[\w$]*")
NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
MARK = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
OPENERS, CLOSERS = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")


class ParseError(ValueError):
    """A text that is no JavaScript: something is left open or closed that was not open."""


@dataclass
class Token:
    kind: str  # word, string, template, number, regex, mark, private
    text: str
    line: int
    fresh: bool  # a line break lies before it


@dataclass
class Parsed:
    """Records in source order; the fields of a record are keys of a dict."""

    imports: list[dict] = field(default_factory=list)
    exports: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    functions: list[dict] = field(default_factory=list)


def _string_end(text: str, at: int) -> int:
    quote, k = text[at], at + 1
    while k < len(text):
        if text[k] == "\\":
            k += 2
        elif text[k] == quote:
            return k + 1
        elif text[k] == "\n":
            break
        else:
            k += 1
    raise ParseError("unterminated string")


def _regex_end(text: str, at: int) -> int:
    k, in_class = at + 1, False
    while k < len(text) and text[k] != "\n":
        c = text[k]
        if c == "\\":
            k += 1
        elif c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        elif c == "/" and not in_class:
            k += 1
            while k < len(text) and (text[k].isalnum() or text[k] in "_$"):
                k += 1
            return k
        k += 1
    raise ParseError("unterminated regular expression")


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}


def _unquote(raw: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] in "xu" and len(c) > 1:
            return chr(int(c[1:].strip("{}"), 16))
        return _ESCAPES.get(c, c)

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|[\s\S])", one, raw[1:-1])


def tokenize(text: str) -> list[Token]:
    """Tokens of a source; the parts of a template between braces are tokens too. Brackets must match."""
    out: list[Token] = []
    at, line, fresh = 0, 1, True
    nested: list[str] = []  # open brackets; "`" for a template whose braces are open
    before_paren: list[str] = []
    if text.startswith("#!"):
        at = text.find("\n") if "\n" in text else len(text)

    def add(kind: str, value: str) -> None:
        nonlocal fresh
        out.append(Token(kind, value, line, fresh))
        fresh = False

    def template(k: int) -> int:
        """Reads from behind a backtick or a brace to the next ``${`` or the end of the template."""
        nonlocal line
        while k < len(text):
            c = text[k]
            if c == "\\":
                line += text[k + 1 : k + 2] == "\n"
                k += 2
                continue
            if c == "`":
                return k + 1
            if c == "$" and text[k + 1 : k + 2] == "{":
                nested.append("`")
                return k + 2
            line += c == "\n"
            k += 1
        raise ParseError("unterminated template")

    closed_if = False
    while at < len(text):
        c = text[at]
        if m := SPACE.match(text, at):
            breaks = m[0].count("\n")
            line += breaks
            fresh = fresh or breaks > 0
            at = m.end()
            continue
        if text.startswith("//", at) or text.startswith("<!--", at):
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
            continue
        if text.startswith("/*", at):
            end = text.find("*/", at + 2)
            if end < 0:
                raise ParseError("unterminated comment")
            breaks = text.count("\n", at, end)
            line += breaks
            fresh = fresh or breaks > 0
            at = end + 2
            continue
        if c in "\"'":
            end = _string_end(text, at)
            add("string", _unquote(text[at:end]))
            line += text.count("\n", at, end)
            at = end
        elif c == "`":
            add("template", "")
            at = template(at + 1)
        elif c == "}" and nested and nested[-1] == "`":
            nested.pop()
            add("mark", "${}")
            at = template(at + 1)
        elif (m := WORD.match(text, at)) is not None:
            add("word", m[0])
            at = m.end()
        elif c.isdigit() or c == "." and text[at + 1 : at + 2].isdigit():
            m = NUMBER.match(text, at)
            add("number", m[0])
            at = m.end()
        elif c == "#" and WORD.match(text, at + 1):
            m = WORD.match(text, at + 1)
            add("private", m[0])
            at = m.end()
        elif c == "/" and _regex_may_start(out[-1] if out else None, closed_if):
            end = _regex_end(text, at)
            add("regex", text[at:end])
            at = end
        elif (m := MARK.match(text, at)) is not None:
            mark = m[0]
            if mark == "/=" and _regex_may_start(out[-1] if out else None, closed_if):
                end = _regex_end(text, at)
                add("regex", text[at:end])
                at = end
                continue
            closed_if = False
            if mark in OPENERS:
                nested.append(mark)
                if mark == "(":
                    before_paren.append(out[-1].text if out and out[-1].kind == "word" else "")
            elif mark in CLOSERS:
                if not nested or nested[-1] == "`" or OPENERS[nested.pop()] != mark:
                    raise ParseError(f"unexpected {mark} in line {line}")
                if mark == ")":
                    closed_if = before_paren.pop() in ("if", "while", "for", "with")
            add("mark", mark)
            at = m.end()
        else:
            raise ParseError(f"unexpected character in line {line}")
    if nested:
        raise ParseError("something is left open at the end")
    return out


def _regex_may_start(last: Token | None, closed_if: bool) -> bool:
    if last is None:
        return True
    if last.kind == "word":
        return last.text in KEYWORDS_BEFORE_REGEX
    if last.kind == "mark":
        return closed_if if last.text == ")" else last.text not in ("]", "}", "${}", "++", "--")
    return False


class _Reader:
    def __init__(self, tokens: list[Token], dynamic_imports: bool):
        self.tokens, self.dynamic = tokens, dynamic_imports
        self.out = Parsed()
        self.ends = self._matching()

    def _matching(self) -> dict[int, int]:
        ends, open_ = {}, []
        for k, t in enumerate(self.tokens):
            if t.kind == "mark":
                if t.text in OPENERS:
                    open_.append(k)
                elif t.text in CLOSERS:
                    ends[open_.pop()] = k
        return ends

    def text(self, k: int) -> str | None:
        t = self.tokens[k] if 0 <= k < len(self.tokens) else None
        return t.text if t and t.kind in ("word", "mark") else None

    def kind(self, k: int) -> str | None:
        return self.tokens[k].kind if 0 <= k < len(self.tokens) else None

    def starts_statement(self, k: int) -> bool:
        if k == 0:
            return True
        return self.text(k - 1) in (";", "{", "}", ")") or self.tokens[k].fresh and self.kind(k - 1) != "mark" or self.text(k - 1) in ("]", "export")

    def string(self, k: int) -> str | None:
        return self.tokens[k].text if self.kind(k) == "string" else None

    def params(self, k: int) -> int:
        """Parameters between the parenthesis at k and its end."""
        end = self.ends[k]
        count, at, last_comma = (1 if end > k + 1 else 0), k + 1, False
        while at < end:
            last_comma = self.text(at) == ","
            count += last_comma
            at = self.ends[at] + 1 if at in self.ends else at + 1
        return count - (1 if last_comma else 0)

    def run(self) -> Parsed:
        for k, t in enumerate(self.tokens):
            if t.kind == "word":
                if t.text == "function":
                    self.function(k)
                elif t.text == "class":
                    self.klass(k)
                elif t.text == "import":
                    self.imported(k)
                elif t.text == "export":
                    self.exported(k)
                elif t.text in ("module", "exports"):
                    self.commonjs(k)
                if self.text(k + 1) == "(" and self.text(k - 1) not in (".", "?."):
                    self.called(k)
        return self.out

    def function(self, k: int) -> None:
        is_async = self.text(k - 1) == "async"
        first = k - 1 if is_async else k
        generator = self.text(k + 1) == "*"
        at = k + 2 if generator else k + 1
        default = self.text(first - 1) == "default" and self.text(first - 2) == "export"
        if self.kind(at) == "word" and self.text(at + 1) == "(" and (default or self.starts_statement(first)):
            self.out.functions.append(
                {"type": "function", "name": self.text(at), "params": self.params(at + 1), "is_async": is_async,
                 "is_generator": generator, "line": self.tokens[first].line}
            )

    def klass(self, k: int) -> None:
        default = self.text(k - 1) == "default" and self.text(k - 2) == "export"
        if self.text(k - 1) in (".", "?.") or not default and not self.starts_statement(k):
            return
        at, name = k + 1, "AnonymousClass"
        if self.kind(at) == "word" and self.text(at) != "extends":
            name = self.text(at)
            at += 1
        elif not default:
            return
        while at < len(self.tokens) and self.text(at) != "{":
            at = self.ends.get(at, at) + 1
        if at < len(self.tokens):
            self.members(name, at)

    def members(self, name: str, body: int) -> None:
        at, end = body + 1, self.ends[body]
        while at < end:
            start, flags = at, set()
            while self.kind(at) == "word" and self.text(at) in ("static", "async", "get", "set") or self.text(at) == "*":
                after = self.text(at + 1)
                if self.text(at) != "*" and (after in ("(", "=", ";", "}") or at + 1 >= end or self.tokens[at + 1].fresh and self.text(at) != "static"):
                    break
                flags.add(self.text(at))
                at += 1
            key = self.tokens[at]
            named = key.kind in ("word", "string", "number") and self.text(at + 1) == "("
            if named:
                kind = "constructor" if key.text == "constructor" and "static" not in flags else "get" if "get" in flags else "set" if "set" in flags else "method"
                self.out.functions.append(
                    {"type": "method", "name": f"{name}.{key.text}", "class_name": name, "method_name": key.text, "kind": kind,
                     "is_static": "static" in flags, "is_async": "async" in flags,
                     "params": self.params(at + 1), "line": self.tokens[start].line}
                )
            at = self.member_end(at, end)

    def member_end(self, at: int, end: int) -> int:
        """Behind the member that begins at ``at``: a body ends it, or a semicolon, or a field's last line."""
        field_ = False
        while at < end:
            mark = self.text(at)
            if mark == ";":
                return at + 1
            field_ = field_ or mark == "="
            if at in self.ends:
                at = self.ends[at] + 1
                if mark == "{" and not field_:
                    return at
            else:
                at += 1
            if at < end and self.tokens[at].fresh:
                whole = self.kind(at - 1) != "mark" or self.text(at - 1) in CLOSERS
                if field_ and whole and self.kind(at) != "mark":
                    return at
                if not field_ and self.kind(at - 1) in ("word", "private") and self.text(at) not in ("(", "=", "{"):
                    return at
        return at

    def names(self, k: int, alias_last: bool) -> list[str]:
        """Names in braces at k: the last or the first word of ``a as b``."""
        out, part = [], []
        for at in range(k + 1, self.ends[k] + 1):
            if self.text(at) == "," or at == self.ends[k]:
                if part:
                    out.append(part[-1] if alias_last else part[0])
                part = []
            elif self.kind(at) in ("word", "string") and not (part and self.text(at) == "as"):
                part.append(self.tokens[at].text)
        return out

    def imported(self, k: int) -> None:
        line = self.tokens[k].line
        if self.text(k + 1) == "(":
            if self.dynamic and self.string(k + 2) is not None:
                self.out.imports.append({"type": "dynamic-import", "source": self.string(k + 2), "dynamic": True, "line": line})
            return
        if self.text(k + 1) == "." or self.text(k - 1) in (".", "?.") or not self.starts_statement(k):
            return
        names, at = [], k + 1
        if self.string(at) is not None:
            self.out.imports.append({"type": "import", "source": self.string(at), "specifiers": ["*"], "line": line})
            return
        while at < len(self.tokens) and self.text(at) != "from":
            if self.text(at) == "{":
                names += self.names(at, alias_last=False)
                at = self.ends[at]
            elif self.text(at) == "*":
                names.append("*")
                at += 2  # as name
            elif self.kind(at) == "word":
                names.append("default")
            at += 1
            if at < len(self.tokens) and self.text(at) in (";", "}"):
                return
        source = self.string(at + 1)
        if source is not None:
            self.out.imports.append({"type": "import", "source": source, "specifiers": names or ["*"], "line": line})

    def exported(self, k: int) -> None:
        line = self.tokens[k].line
        if self.text(k - 1) in (".", "?.") or self.text(k + 1) in (":", "(", "=", ".", ",", "}"):
            return
        if self.text(k + 1) == "default":
            self.out.exports.append({"type": "default", "specifiers": ["default"], "line": line})
        elif self.text(k + 1) == "*":
            at = k + 2
            while at < len(self.tokens) and self.text(at) != "from":
                at += 1
            source = self.string(at + 1)
            if source is not None and self.text(k + 2) == "as":
                self.out.imports.append({"type": "import", "source": source, "specifiers": [self.tokens[k + 3].text], "line": line})
                self.out.exports.append({"type": "named", "specifiers": [self.tokens[k + 3].text], "line": line})
            elif source is not None:
                self.out.imports.append({"type": "import", "source": source, "specifiers": ["*"], "line": line})
                self.out.exports.append({"type": "all", "source": source, "line": line})
        elif self.text(k + 1) == "{":
            names = self.names(k + 1, alias_last=True)
            end = self.ends[k + 1]
            source = self.string(end + 2) if self.text(end + 1) == "from" else None
            if source is not None:
                self.out.imports.append({"type": "import", "source": source, "specifiers": names, "line": line})
            self.out.exports.append({"type": "named", "specifiers": names, "line": line})
        elif self.kind(k + 1) == "word":
            self.out.exports.append({"type": "named", "specifiers": [], "line": line})

    def commonjs(self, k: int) -> None:
        line = self.tokens[k].line
        if self.text(k - 1) in (".", "?."):
            return
        if self.text(k) == "module":
            if self.text(k + 1) == "." and self.text(k + 2) == "exports" and self.text(k + 3) == "=":
                self.out.exports.append({"type": "commonjs", "line": line})
        elif self.text(k + 1) == "." and self.kind(k + 2) == "word" and self.text(k + 3) == "=":
            self.out.exports.append({"type": "commonjs", "property": self.text(k + 2), "line": line})
        elif self.text(k + 1) == "[" and self.text(self.ends[k + 1] + 1) == "=":
            self.out.exports.append({"type": "commonjs", "line": line})

    def called(self, k: int) -> None:
        word, line = self.text(k), self.tokens[k].line
        if word in ("if", "for", "while", "switch", "catch", "with", "function", "return", "import", "super", "typeof", "await") or self.text(k - 1) in ("function", "new"):
            return
        if self.text(k - 1) == "*" and self.text(k - 2) == "function":
            return
        end = self.ends[k + 1]
        if self.text(end + 1) == "{":  # a method's name
            return
        if word == "require" and end > k + 2:
            source = self.string(k + 2) if end == k + 3 or self.text(k + 3) == "," else None
            self.out.imports.append({"type": "require", "source": source, "dynamic": source is None, "line": line})
        self.out.calls.append({"function": word, "line": line})


def parse(text: str, dynamic_imports: bool = False) -> Parsed:
    """Records of a source text; raises ParseError where the text is no JavaScript."""
    return _Reader(tokenize(text), dynamic_imports).run()
