"""Test methods in source files of several languages.

Each scanner first blanks comments and the insides of strings (same length, same lines), so that patterns and brace matching
only see code; names and values are then read from the original text. A scanner accepts the constructs named in its
docstring and skips the rest. Rows: fqcn, method, begin_line, end_line, loc, tags, display_name.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .tables import suffixes_for


@dataclass
class Found:
    fqcn: str
    method: str
    begin_line: int
    end_line: int
    tags: list[str] = field(default_factory=list)
    display_name: str | None = None


class SourceError(ValueError):
    """The file isn't readable as its language; the scan goes on with the next."""


class Lines:
    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, place: int) -> int:
        return bisect.bisect_right(self.starts, place)


def blanker(*pairs: tuple[str, bool]) -> Callable[[str], str]:
    """A function that blanks what patterns match. Of strings (True) the quotes stay."""
    whole = re.compile("|".join(f"(?P<g{n}>{p})" for n, (p, _) in enumerate(pairs)), re.S)
    string = {f"g{n}": s for n, (_, s) in enumerate(pairs)}
    clear = lambda s: re.sub(r"[^\n]", " ", s)

    def one(m: re.Match) -> str:
        s = m[0]
        return s[0] + clear(s[1:-1]) + s[-1] if string[m.lastgroup] and len(s) > 1 else clear(s)

    return lambda text: whole.sub(one, text)


def closing(code: str, start: int, pair: str = "{}") -> int:
    """Where the bracket at start is closed, or the end of the text."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(code, start):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.start()
    return max(start, len(code) - 1)


def unescaped(literal: str) -> str:
    """The value of a quoted literal with backslashes."""
    named = {"n": "\n", "r": "\r", "t": "\t"}
    return re.sub(r"\\(.)", lambda m: named.get(m[1], m[1]), literal[1:-1], flags=re.S)


LITERAL = re.compile(r'"(?:\\.|[^"\\])*"', re.S)

# --- Java

JAVA_BLANK = blanker((r"/\*.*?(?:\*/|\Z)", False), (r"//[^\n]*", False), (r'""".*?(?:"""|\Z)', True), (r'"(?:\\.|[^"\\\n])*"', True), (r"'(?:\\.|[^'\\\n])+'", True))
# Annotations that mark tests.
JAVA_MARKERS = frozenset(("Test", "ParameterizedTest", "RepeatedTest", "TestFactory", "TestTemplate"))
JAVA_OLD_MARKERS = frozenset(("Test", "Theory"))
JAVA_TYPE = re.compile(r"(?<![\w.@])(?:class|interface)\s+(\w+)[^{;]*\{")
JAVA_ANNOTATION = re.compile(r"@(?!interface\b)([\w.]+)\s*(\()?")
JAVA_METHOD = re.compile(r"\s*(?:(?:public|protected|private|static|final|abstract|default|synchronized|native|strictfp)\s+)*(?:<[^{};=()]*>\s*)?[\w.]+(?:\s*<[^{};=()]*>)?(?:\s*\[\s*\])*\s+(\w+)\s*\(")


def java_annotations(text: str, code: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """Annotations from a place on as (name, arguments), and where they end. Modifiers may stand between them."""
    out = []
    modifier = re.compile(r"\s*(?:(?:public|protected|private|static|final|abstract|default|synchronized)\b\s*)*(?=@(?!interface\b))")
    while (gap := modifier.match(code, at)) and (m := JAVA_ANNOTATION.match(code, gap.end())):
        end = closing(code, m.end() - 1, "()") + 1 if m[2] else m.end(1)
        out.append((m[1], text[m.end() : end - 1] if m[2] else ""))
        at = end
    return out, at


def java_string(arguments: str) -> str | None:
    """The literal that is an annotation's only, or value, argument."""
    m = re.fullmatch(r'\s*(?:value\s*=\s*)?("(?:\\.|[^"\\])*")\s*', arguments, re.S) or re.search(r'(?:^|,)\s*value\s*=\s*("(?:\\.|[^"\\])*")\s*(?:,|$)', arguments, re.S)
    return unescaped(m[1]) if m else None


def scan_java(text: str, path: str = "", markers: frozenset[str] | None = None) -> Iterator[Found]:
    """Methods with a test annotation, by its simple name, in classes and interfaces. A nested class's tests are also those of the classes around it; its name is package and own name."""
    code = JAVA_BLANK(text)
    if code.count("{") != code.count("}"):
        raise SourceError("braces don't match")
    package = m[1] if (m := re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", code)) else ""
    use = markers or JAVA_MARKERS
    if not markers:
        imports = re.findall(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)", code)
        if any(i.startswith(("org.junit", "junit.framework")) and not i.startswith("org.junit.jupiter") for i in imports):
            use = use | JAVA_OLD_MARKERS
    lines, tests = Lines(text), []
    at = 0
    while m := re.compile(r"@(?!interface\b)[\w.]+").search(code, at):
        found, end = java_annotations(text, code, m.start())
        at = max(end, m.end())
        if not any(n.rsplit(".", 1)[-1] in use for n, _ in found):
            continue
        if not (head := JAVA_METHOD.match(code, end)):
            continue
        after = closing(code, head.end() - 1, "()") + 1
        body = re.compile(r"[^{;]*([{;])").match(code, after)
        stop = (closing(code, body.end() - 1) if body[1] == "{" else body.end() - 1) if body else after
        tags = []
        for name, arguments in found:
            if name == "Tag" and (v := java_string(arguments)) is not None:
                tags.append(v)
            elif name == "Tags":
                blank = JAVA_BLANK(arguments)
                for t in re.finditer(r"@Tag\s*\(", blank):
                    if (v := java_string(arguments[t.end() : closing(blank, t.end() - 1, "()")])) is not None:
                        tags.append(v)
        name = next((java_string(a) for n, a in found if n == "DisplayName"), None)
        begin = re.compile(r"\s*").match(code, m.start()).end()
        before = re.search(r"(?:\b(?:public|protected|private|static|final|abstract|default|synchronized)\s+)+\Z", code[: m.start()])
        tests.append((before.start() if before else begin, stop, head[1], tags, name))
    for t in JAVA_TYPE.finditer(code):
        end = closing(code, t.end() - 1)
        fqcn = f"{package}.{t[1]}" if package else t[1]
        for begin, stop, method, tags, name in tests:
            if t.end() <= begin and stop <= end:
                yield Found(fqcn, method, lines.at(begin), lines.at(stop), tags, name)


# --- C#

CS_BLANK = blanker((r"/\*.*?(?:\*/|\Z)", False), (r"//[^\n]*", False), (r'"""+.*?(?:"""+|\Z)', True), (r'\$?@\$?"(?:""|[^"])*"', True), (r'\$?"(?:\\.|[^"\\\n])*"', True), (r"'(?:\\.|[^'\\\n])+'", True), (r"(?m:^[ \t]*#[^\n]*)", False))
# What a framework's tests and tags are called.
CS_FRAMEWORKS = {"xunit": (("Fact", "Theory"), ("Trait",)), "nunit": (("Test", "TestCase", "TestCaseSource"), ("Category",)), "mstest": (("TestMethod", "DataTestMethod"), ("TestCategory",))}
CS_SCOPE = re.compile(r"\b(namespace|class|struct|record|interface)\s+(?:(?:struct|class)\s+)?([\w.]+)")
CS_SECTION = re.compile(r"\[(?:\s*\w+\s*:)?\s*[A-Za-z_]")
CS_METHOD = re.compile(r"\s*(?:(?:public|protected|private|internal|static|virtual|override|abstract|sealed|async|new|unsafe|extern|partial|readonly)\s+)*[\w.:]+(?:\s*<[^{};=()]*>)?(?:\s*\[[\s,]*\])*\??\s+([\w.]+)(?:\s*<[^{};()]*>)?\s*\(")


def cs_framework(usings: Sequence[str]) -> str | None:
    for u in usings:
        if u == "Xunit" or u.startswith("Xunit."):
            return "xunit"
        if u == "NUnit.Framework" or u.startswith("NUnit."):
            return "nunit"
        if "VisualStudio.TestTools" in u:
            return "mstest"
    return None


def cs_string(literal: str) -> str | None:
    s = literal.strip()
    if s.startswith('"""'):
        return s[3:-3]
    if s.startswith('@"') and s.endswith('"'):
        return s[2:-1].replace('""', '"')
    return unescaped(s) if len(s) > 1 and s[0] == s[-1] == '"' else None


def split_top(text: str, code: str) -> list[str]:
    """Arguments at the outermost level."""
    out, depth, last = [], 0, 0
    for n, c in enumerate(code):
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth == 0:
            out.append(text[last:n])
            last = n + 1
    return [*out, text[last:]] if text.strip() else []


def cs_attributes(text: str, code: str, start: int) -> tuple[list[tuple[str, list[str | None], dict[str, str]]], int]:
    out, at = [], start
    while (gap := re.compile(r"\s*").match(code, at)) and code.startswith("[", gap.end()):
        open_, end = gap.end(), closing(code, gap.end(), "[]")
        for part in split_top(text[open_ + 1 : end], code[open_ + 1 : end]):
            if not (m := re.match(r"\s*(?:\w+\s*:(?!:)\s*)?([\w.]+)\s*(\(.*\))?\s*\Z", part, re.S)):
                continue
            inner = m[2][1:-1] if m[2] else ""
            positional, named = [], {}
            for a in split_top(inner, CS_BLANK(inner)):
                if k := re.match(r"\s*(\w+)\s*=(?!=)\s*(.*)", a, re.S):
                    if (v := cs_string(k[2])) is not None:
                        named[k[1]] = v
                else:
                    positional.append(cs_string(a))
            out.append((m[1].rsplit(".", 1)[-1], positional, named))
        at = end + 1
    return out, at


def scan_csharp(text: str, path: str = "", markers: frozenset[str] | None = None) -> Iterator[Found]:
    """xUnit, NUnit and MSTest methods by attribute; the framework follows from using directives anywhere in the file. Names go through namespaces and all classes."""
    code, lines = CS_BLANK(text), Lines(text)
    usings = re.findall(r"\busing\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", code)
    framework = cs_framework(usings)
    known = [CS_FRAMEWORKS[framework]] if framework else list(CS_FRAMEWORKS.values())
    use = markers or frozenset(m for f in known for m in f[0])
    tag_names = {t for f in known for t in f[1]}
    scopes = []
    for m in CS_SCOPE.finditer(code):
        rest = re.compile(r"[^{;]*([{;])").match(code, m.end())
        if rest:
            scopes.append((m.start(), closing(code, rest.end() - 1) if rest[1] == "{" else (len(code) if m[1] == "namespace" else rest.end()), m[2]))
    at = 0
    while m := CS_SECTION.search(code, at):
        at = m.end()
        if not re.search(r"[{};\]]\s*\Z", code[max(0, m.start() - 2000) : m.start()]) and code[: m.start()].strip():
            continue
        found, end = cs_attributes(text, code, m.start())
        head = CS_METHOD.match(code, end)
        at = max(at, end)
        if not head or not any(n in use for n, _, _ in found):
            continue
        body = re.compile(r"[^{;=]*(\{|;|=>)").match(code, closing(code, head.end() - 1, "()") + 1)
        stop = head.end()
        if body:
            stop = closing(code, body.end() - 1) if body[1] == "{" else body.end() - 1 if body[1] == ";" else code.find(";", body.end())
        tags = []
        for name, positional, _ in found:
            if name not in tag_names:
                continue
            if framework == "xunit":
                if len(positional) > 1 and positional[1] is not None and (positional[0] or "").lower() in ("tag", "category"):
                    tags.append(positional[1])
            elif positional and positional[0] is not None:
                tags.append(positional[0])
        shown = next((named.get("DisplayName") for n, _, named in found if n in ("Fact", "Theory")), None) if framework == "xunit" else None
        fqcn = ".".join(name for a, b, name in scopes if a < m.start() <= b)
        yield Found(fqcn, head[1].rsplit(".", 1)[-1], lines.at(m.start()), lines.at(max(stop, head.end() - 1)), tags, shown)


# --- TypeScript and JavaScript

TS_BLANK = blanker((r"/\*.*?(?:\*/|\Z)", False), (r"//[^\n]*", False), (r'"(?:\\.|[^"\\\n])*"', True), (r"'(?:\\.|[^'\\\n])*'", True), (r"`(?:\\.|[^`\\])*`", True))
TS_SUITES = frozenset(("describe", "context", "suite", "fdescribe", "xdescribe"))
TS_CALL = re.compile(r"(?<![\w.$])([A-Za-z_$][\w$]*)((?:\s*\.\s*[A-Za-z_$][\w$]*)*)\s*([(`])")


def ts_name(text: str, code: str, open_: int) -> str:
    m = re.compile(r"\s*([\"'`])").match(code, open_ + 1)
    if not m:
        return "<anonymous>"
    end = code.find(m[1], m.end())
    literal = text[m.end() - 1 : end + 1]
    value = re.sub(r"\$\{[^}]*\}", "${...}", unescaped(literal)) if m[1] == "`" else unescaped(literal)
    return value or "<anonymous>"


def scan_typescript(text: str, path: str = "", markers: frozenset[str] | None = None) -> Iterator[Found]:
    """Calls of test and it, with .each, .skip and the like, inside of describe blocks, whose names lead the test's. The class is the file's stem."""
    code, lines = TS_BLANK(text), Lines(text)
    tests = markers or frozenset(("test", "it"))
    stem = re.sub(r"\.[^.]*\Z", "", path.rsplit("/", 1)[-1])
    suites: list[tuple[int, str]] = []
    skip = at = 0
    while m := TS_CALL.search(code, at):
        at = m.end()
        if m[1] not in tests and m[1] not in TS_SUITES or m.start() < skip:
            continue
        open_, end = m.end() - 1, m.end() - 1
        while True:
            # each(table)(name, body) and each`table`(name, body): the last call has the name
            end = code.find("`", open_ + 1) if code[open_] == "`" else closing(code, open_, "()")
            more = re.compile(r"\s*([(`])").match(code, end + 1)
            if not more:
                break
            open_ = more.end() - 1
        if code[open_] == "`":
            continue
        suites = [s for s in suites if s[0] > m.start()]
        name = ts_name(text, code, open_)
        if m[1] in TS_SUITES:
            suites.append((end, name))
        else:
            skip = end
            yield Found(stem, " > ".join([*(s[1] for s in suites), name]), lines.at(m.start()), lines.at(end))


# --- Go

GO_BLANK = blanker((r"/\*.*?(?:\*/|\Z)", False), (r"//[^\n]*", False), (r'"(?:\\.|[^"\\\n])*"', True), (r"`[^`]*`", True), (r"'(?:\\.|[^'\\\n])+'", True))
GO_FUNC = re.compile(r"(?m)^func\s+(Test\w*)\s*(?:\[[^\]]*\]\s*)?\(")


def scan_go(text: str, path: str = "", markers: frozenset[str] | None = None) -> Iterator[Found]:
    """Functions Test, Test_x and TestX (not Test1) with a *testing.T parameter. The class is the package, else the folder."""
    code, lines = GO_BLANK(text), Lines(text)
    package = m[1] if (m := re.search(r"(?m)^\s*package\s+(\w+)", code)) else path.rpartition("/")[0].strip("/").replace("/", ".")
    for m in GO_FUNC.finditer(code):
        following = m[1][4:5]
        end = closing(code, m.end() - 1, "()")
        if (following and not (following.isupper() or following == "_")) or not re.search(r"\*\s*testing\s*\.\s*T\b", code[m.end() : end]):
            continue
        body = code.find("{", end)
        yield Found(package, m[1], lines.at(m.start()), lines.at(closing(code, body) if body >= 0 else end))


# --- Python


def is_python_test(name: str, suffixes: Sequence[str] = ("_test.py",)) -> bool:
    return bool(re.fullmatch(r"test_.*\.py", name)) or any(name.endswith(s) for s in suffixes)


def scan_python(text: str, path: str = "", markers: frozenset[str] | None = None) -> Iterator[Found]:
    """Functions test_* at the top and in classes named Test*, *Test or *Tests (nested classes aren't searched); bare pytest marks are tags."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        raise SourceError(str(e)) from e
    module = re.sub(r"\.py\Z", "", path).strip("/").replace("/", ".")
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    groups = [(module, [n for n in tree.body if isinstance(n, functions)])]
    for n in tree.body:
        if isinstance(n, ast.ClassDef) and (n.name.startswith("Test") or n.name.endswith(("Test", "Tests"))):
            groups.append((f"{module}.{n.name}" if module else n.name, [x for x in n.body if isinstance(x, functions)]))
    for fqcn, nodes in groups:
        for f in nodes:
            if f.name.startswith("test_"):
                marks = [d.attr for d in f.decorator_list if isinstance(d, ast.Attribute) and ast.unparse(d.value) == "pytest.mark"]
                yield Found(fqcn, f.name, f.lineno, f.end_lineno or f.lineno, marks)


# --- PowerShell

PS_BLANK = blanker((r"<#.*?(?:#>|\Z)", False), (r"(?<![\w`])#[^\n]*", False), (r'"(?:`.|""|[^"`])*"', True), (r"'(?:''|[^'])*'", True))
PS_IT = re.compile(r"(?i)(?<![\w-])It\s+(?:-Name\s+)?([\"'])")


def ps_string(s: str) -> str:
    return s[1:-1].replace('`"', '"') if s[0] == '"' else s[1:-1].replace("''", "'")


def scan_powershell(text: str, path: str = "", markers: frozenset[str] | None = None) -> Iterator[Found]:
    """It blocks, in any case and depth; only their own -Tag counts. The class is the file's stem."""
    code, lines = PS_BLANK(text), Lines(text)
    stem = re.sub(r"(?i)(?:\.tests)?\.ps1\Z", "", path.rsplit("/", 1)[-1])
    for m in PS_IT.finditer(code):
        end = code.find(m[1], m.end())
        brace = code.find("{", end)
        if end < 0 or brace < 0:
            continue
        tags = []
        for t in re.finditer(r"(?i)-Tag\s+((?:[\"'][^\"']*[\"']\s*,?\s*)+)", code[end + 1 : brace]):
            part = text[end + 1 + t.start(1) : end + 1 + t.end(1)]
            tags += [ps_string(x[0]) for x in re.finditer(r'"(?:`.|[^"])*"|\'(?:\'\'|[^\'])*\'', part)]
        yield Found(stem, ps_string(text[m.end() - 1 : end + 1]), lines.at(m.start()), lines.at(closing(code, brace)), tags)


# --- ABAP and its scripts

ABAP_BLANK = blanker((r"(?m:^\*[^\n]*)", False), (r'"[^\n]*', False), (r"'(?:''|[^'])*'", True), (r"`(?:``|[^`])*`", True))
ABAP_TOKEN = re.compile(r"[\w~]+|[.,:]")


def scan_abap(text: str, path: str = "", markers: frozenset[str] | None = None) -> Iterator[Found]:
    """Methods that a class definition FOR TESTING declares FOR TESTING, at their implementation below it; names in upper case."""
    code, lines = ABAP_BLANK(text), Lines(text)
    tokens = [(m[0].upper(), m.start()) for m in ABAP_TOKEN.finditer(code)]
    words = [t for t, _ in tokens]
    tests: dict[str, set[str]] = {}
    k = 0
    while k + 2 < len(words):
        if words[k] != "CLASS" or words[k + 2] not in ("DEFINITION", "IMPLEMENTATION"):
            k += 1
            continue
        name, kind = words[k + 1], words[k + 2]
        end = next((n for n in range(k + 3, len(words)) if words[n] == "ENDCLASS"), len(words))
        if kind == "DEFINITION":
            dot = next((n for n in range(k + 3, end) if words[n] == "."), end)
            if any(words[n : n + 2] == ["FOR", "TESTING"] for n in range(k + 3, dot)):
                n = dot + 1
                while n < end:
                    if words[n] != "METHODS":
                        n += 1
                        continue
                    stop = next((x for x in range(n, end) if words[x] == "."), end)
                    part: list[str] = []
                    for w in [*words[n + 1 : stop], ","]:
                        if w == ",":
                            part = [x for x in part if x != ":"]
                            if part and any(part[x : x + 2] == ["FOR", "TESTING"] for x in range(1, len(part))):
                                tests.setdefault(name, set()).add(part[0])
                            part = []
                        else:
                            part.append(w)
                    n = stop + 1
        else:
            n = k + 3
            while n < end:
                if words[n] == "METHOD" and n + 1 < end:
                    stop = next((x for x in range(n + 2, end) if words[x] == "ENDMETHOD"), min(end, len(words) - 1))
                    if words[n + 1] in tests.get(name, ()):
                        yield Found(name, words[n + 1], lines.at(tokens[n][1]), lines.at(tokens[stop][1]))
                    n = stop + 1
                else:
                    n += 1
        k = end + 1


def scan_ecatt(text: str, path: str = "", markers: frozenset[str] | None = None) -> Iterator[Found]:
    """FUNCTION blocks, to the line before the next one or the last line with text; class and method are the function's name."""
    rows = text.split("\n")
    starts = [(n, m[1]) for n, row in enumerate(rows) if (m := re.match(r"(?i)\s*FUNCTION\s+(\w+)", row))]
    for k, (n, name) in enumerate(starts):
        end = starts[k + 1][0] - 1 if k + 1 < len(starts) else len(rows) - 1
        while end > n and not rows[end].strip():
            end -= 1
        yield Found(name, name, n + 1, end + 1)


# --- COBOL

COBOL_BOUNDARY = re.compile(r"(?i)(?<![\w-])(?:(MFU-TC-[\w-]+)|(TestCase)\s+('(?:''|[^'])*'|\"(?:\"\"|[^\"])*\"|\S+)|(TestSuite)\b)")


def scan_cobol(text: str, path: str = "", markers: frozenset[str] | None = None) -> Iterator[Found]:
    """MFU-TC-* paragraphs and TestCase blocks, each to the line before the next boundary that is further down; suites only bound. The class is the file's stem."""
    code = re.sub(r"(?m)^(.{6})\*[^\n]*|\*>[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    lines = Lines(text)
    stem = re.sub(r"\.[^.]*\Z", "", path.rsplit("/", 1)[-1])
    found = list(COBOL_BOUNDARY.finditer(code))
    bounds = sorted({lines.at(m.start()) for m in found} | {text.count("\n") + 1})
    for m in found:
        begin = lines.at(m.start())
        following = bisect.bisect_right(bounds, begin)
        end = max(begin, bounds[following] - 1) if following < len(bounds) else begin
        if m[1]:
            yield Found(stem, m[1].upper(), begin, end)
        elif m[2]:
            quote = m[3][0]
            name = m[3][1:-1].replace(quote * 2, quote) if quote in "'\"" else m[3]
            if name:
                yield Found(stem, name, begin, end)


# --- registry

Scanner = Callable[..., Iterator[Found]]


@dataclass(frozen=True)
class Plugin:
    """A scanner of files with some suffixes. configure: given a run's settings, gives the scanner to use; close: is called when the run is over."""

    id: str
    suffixes: tuple[str, ...]
    scanner: Scanner
    configure: Callable[[Mapping[str, object]], Scanner] | None = None
    close: Callable[[], None] | None = None


#: Plug-ins by id, in the order in which they are asked.
PLUGINS: dict[str, Plugin] = {}


def register(plugin: str, suffixes: Sequence[str], scanner: Scanner, configure: Callable[[Mapping[str, object]], Scanner] | None = None, close: Callable[[], None] | None = None) -> None:
    """Adds a plug-in; an id that is taken is an error."""
    if plugin in PLUGINS:
        raise ValueError(f"plug-in {plugin} is there already")
    PLUGINS[plugin] = Plugin(plugin, tuple(suffixes), scanner, configure, close)


for _id, _suffixes, _scanner in (
    ("java", (".java",), scan_java),
    ("dotnet", (".cs",), scan_csharp),
    ("typescript", (".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx", ".test.js", ".spec.js"), scan_typescript),
    ("go", ("_test.go",), scan_go),
    ("python", ("_test.py",), scan_python),
    ("powershell", (".Tests.ps1",), scan_powershell),
    ("abap", (".abap",), scan_abap),
    ("ecatt", (".ecl",), scan_ecatt),
    ("cobol", (".cbl", ".cob", ".cut"), scan_cobol),
):
    register(_id, _suffixes, _scanner)


@contextmanager
def opened(settings: Mapping[str, object] | None = None, enabled: Sequence[str] = ()) -> Iterator[dict[str, Plugin]]:
    """The plug-ins of a run, each configured with its settings once; all are closed at the end, whatever happened. An id that isn't there is an error."""
    unknown = [p for p in enabled if p not in PLUGINS]
    if unknown:
        raise ValueError(f"there is no plug-in {', '.join(unknown)}")
    use = {p: plugin for p, plugin in PLUGINS.items() if not enabled or p in enabled}
    try:
        yield {p: replace(x, scanner=x.configure(settings or {})) if x.configure else x for p, x in use.items()}
    finally:
        for x in use.values():
            if x.close:
                x.close()


def plugin_of(name: str, suffixes: Sequence[str] = (), enabled: Sequence[str] = (), plugins: Mapping[str, Plugin] | None = None) -> str | None:
    """The first plug-in, of those enabled (none named: all), that takes a file of this name."""
    for plugin, x in (PLUGINS if plugins is None else plugins).items():
        if enabled and plugin not in enabled:
            continue
        use = suffixes_for(plugin, suffixes) or x.suffixes
        if any(name.endswith(s) for s in use) or (plugin == "python" and is_python_test(name, use)):
            return plugin
    return None


SCAN_SCHEMA = "seq long, plugin string, fqcn string, method string, begin_line int, end_line int, loc int, tags array<string>, display_name string, file_path string, error string"


def scan_tree(files: DataFrame, root: str, suffixes: Sequence[str] = (), enabled: Sequence[str] = (), markers: Sequence[str] = (), plugins: Mapping[str, Plugin] | None = None) -> DataFrame:
    """Rows of all tests in files (path, content): SCAN_SCHEMA and file_stem; seq is the place in a file. A file that can't be parsed gives one row with its error and no method.

    plugins: those of opened(); none given: all that are registered. They are sent to the tasks as they are.
    """
    below, use = root.rstrip("/") + "/", dict(PLUGINS if plugins is None else plugins)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                name = path.rsplit("/", 1)[-1]
                plugin = plugin_of(name, suffixes, enabled, use)
                if plugin is None or content is None:
                    continue
                inner = path[path.find(below) + len(below) :] if below in path else name
                try:
                    for n, f in enumerate(use[plugin].scanner(content, inner, frozenset(markers) or None)):
                        rows.append((n, plugin, f.fqcn, f.method, f.begin_line, f.end_line, f.end_line - f.begin_line + 1, f.tags, f.display_name, path, None))
                except SourceError as e:
                    rows.append((-1, plugin, None, None, None, None, None, None, None, path, str(e)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCAN_SCHEMA.split(", ")])
            for c in ("begin_line", "end_line", "loc"):
                out[c] = out[c].astype("Int32")
            yield out

    found = files.select("path", "content").mapInPandas(each, SCAN_SCHEMA)
    every = sorted({s for x in use.values() for s in x.suffixes} | {".py"})
    return found.withColumn("file_stem", C.file_stem(F.regexp_replace("file_path", "^.*?" + re.escape(below), below), root, every))


def had_errors(scanned: DataFrame) -> bool:
    return not scanned.where(F.col("error").isNotNull()).isEmpty()


#: What doesn't count in a class: runs of comments and white space. Strings are matched so that their insides stay.
JAVA_SPACE = re.compile(r"((?:/\*.*?(?:\*/|\Z)|//[^\n]*|\s)+)|\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'", re.S)


def java_classes(text: str) -> dict[str, str]:
    """The text of each class and interface by its name, from the end of what stands before its annotations to its last brace; of equal names all, one after the other."""
    code, out = JAVA_BLANK(text), {}
    package = m[1] if (m := re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", code)) else ""
    for t in JAVA_TYPE.finditer(code):
        begin = max(code.rfind(c, 0, t.start()) for c in ";{}") + 1
        fqcn = f"{package}.{t[1]}" if package else t[1]
        out[fqcn] = out.get(fqcn, "") + text[begin : closing(code, t.end() - 1) + 1].strip()
    return out


def java_canonical(text: str) -> str:
    """A class's text in which layout and comments don't count."""
    return JAVA_SPACE.sub(lambda m: " " if m[1] else m[0], text).strip()


def class_sources(scanned: DataFrame, files: DataFrame) -> DataFrame:
    """(fqcn, file_path, source, content_hash) of each class. In Java files it is the class's own text, whose digest leaves layout and comments out,
    so that an edit beside a class doesn't change it; in other languages it is the whole file."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, name, text, hashlib.sha256(java_canonical(text).encode("utf-8", "surrogatepass")).hexdigest()) for path, content in zip(batch["path"], batch["content"]) if content for name, text in java_classes(content).items()]
            yield pd.DataFrame(rows, columns=["file_path", "fqcn", "source", "content_hash"])

    per_class = scanned.where(F.col("fqcn").isNotNull()).select("fqcn", "file_path", "plugin").distinct()
    java = files.where(F.endswith("path", F.lit(".java"))).select("path", "content").mapInPandas(each, "file_path string, fqcn string, source string, content_hash string")
    texts = files.select(F.col("path").alias("file_path"), F.col("content").alias("source"))
    others = per_class.where("plugin <> 'java'").join(texts, "file_path").select("fqcn", "file_path", "source", C.sha256_text(F.col("source")).alias("content_hash"))
    return per_class.where("plugin = 'java'").join(java, ["file_path", "fqcn"]).select("fqcn", "file_path", "source", "content_hash").union(others)
