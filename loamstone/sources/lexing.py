"""Declarations of source files with their line ranges, owners and doc comments.

Strings, raw strings, templates, regular expressions, here-documents and comments are blanked out first, by a scan with a
stack (a template may hold code that holds a template); what is left is code, with every character at its old place, so
brackets and line starts mean what they say. A declaration ends where its brackets are closed again.

Python files are parsed. Go, TypeScript and shell are read from the blanked text.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass


@dataclass
class Declaration:
    """Lines count from 1; ``owner`` is what encloses it, or the type that a method belongs to."""

    name: str
    kind: str
    line: int
    end_line: int
    owner: str | None = None
    doc: str | None = None


# ---- blanking ------------------------------------------------------------------------------------------------------

_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?"
_GO = re.compile(rf"(?P<comment>{_COMMENT})|`[^`]*`?|{_QUOTED}", re.DOTALL)
_TS = re.compile(rf"(?P<comment>{_COMMENT})|{_QUOTED}|(?P<regex>/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])*/[a-z]*)|(?P<mark>[`{{}}])", re.DOTALL)
_TEMPLATE = re.compile(r"\\.|`|\$\{", re.DOTALL)
_SHELL = re.compile(r"(?P<comment>(?:^|(?<=[\s;|&(]))#[^\n]*)|(?P<here><<-?[ \t]*(?P<q>['\"]?)(?P<end>\w+)(?P=q)[^\n]*\n(?P<body>.*?)^[ \t]*(?P=end)[ \t]*(?=\n|\Z))|\\.|'[^']*'?|\"(?:\\.|[^\"\\])*\"?", re.DOTALL | re.MULTILINE)
#: What may stand before a regular expression, where a slash is no division.
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|do|else))\s*\Z")


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


class Code:
    """A text without what is no code: ``code`` has the same length and lines, ``comments`` maps a comment's first line to (last line, text),
    and ``joined`` holds the lines that end inside a string."""

    def __init__(self, text: str, language: str):
        self.text = text
        self.comments: dict[int, tuple[int, str]] = {}
        self.joined: set[int] = set()
        self._starts = [0, *(m.end() for m in re.finditer("\n", text))]
        out: list[str] = []
        at = 0
        for start, end in self._noise(language):
            out += [text[at:start], _blank(text[start:end])]
            at = end
            if "\n" in text[start:end] and self.line_of(start) not in self.comments:
                self.joined |= set(range(self.line_of(start), self.line_of(end - 1)))
        self.code = "".join([*out, text[at:]])
        self.lines = self.code.split("\n")

    def line_of(self, place: int) -> int:
        lo, hi = 0, len(self._starts)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self._starts[mid] <= place else (lo, mid)
        return lo + 1

    def _noise(self, language: str) -> Iterator[tuple[int, int]]:
        if language == "typescript":
            yield from self._typescript()
            return
        for m in (_GO if language == "go" else _SHELL).finditer(self.text):
            if m["comment"] is not None:
                self._comment(m.start(), m.end())
            yield m.span("body") if language == "shell" and m["here"] else m.span()

    def _comment(self, start: int, end: int) -> None:
        self.comments[self.line_of(start)] = (self.line_of(max(start, end - 1)), self.text[start:end])

    def _typescript(self) -> Iterator[tuple[int, int]]:
        """Templates are pushed, and so is the code inside them, which ends at its own closing brace."""
        at, stack = 0, []  # of "`" for a template and "{" for a brace, "$" for code inside a template
        while at < len(self.text):
            if stack and stack[-1] == "`":
                m = _TEMPLATE.search(self.text, at)
                if m is None:
                    yield at, len(self.text)
                    return
                yield at, m.end()
                at = m.end()
                if m[0] == "`":
                    stack.pop()
                elif m[0] == "${":
                    stack.append("$")
                continue
            m = _TS.search(self.text, at)
            if m is None:
                return
            at = m.end()
            if m["regex"] is not None and not _BEFORE_REGEX.search(self.text[max(0, m.start() - 40) : m.start()]):
                at = m.start() + 1
            elif m["mark"] is None:
                if m["comment"] is not None:
                    self._comment(*m.span())
                yield m.span()
            elif m[0] == "`":
                yield m.span()
                stack.append("`")
            elif m[0] == "{":
                stack.append("{")
            elif stack and stack.pop() == "$":
                yield m.span()

    def depths(self) -> list[int]:
        """Open brackets at the end of each line, one more entry than lines, the first for the begin of the text."""
        out, depth = [0], 0
        for line in self.lines:
            depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
            out.append(depth)
        return out

    def doc(self, line: int) -> str | None:
        """The first line with words of the comment that ends on the line before."""
        block: list[str] = []
        while (found := next(((first, c) for first, c in self.comments.items() if c[0] == line - 1 and not self.lines[first - 1].strip()), None)) is not None:
            line, block = found[0], [found[1][1], *block]
        words = (re.sub(r"^[\s/*#]+|[\s*/]+$", "", row) for text in block for row in text.split("\n"))
        return next((w for w in words if w), None)


# ---- declarations --------------------------------------------------------------------------------------------------

_ID = r"[A-Za-z_$][\w$]*"
_GO_FUNC = re.compile(r"func (?:\((?:\w+ +)?\*?(\w+)(?:\[[^\]]*\])?\) )?(\w+)")
_GO_ONE = re.compile(r"(type|var|const) (\w+(?:, *\w+)*)")
_GO_BLOCK = re.compile(r"(type|var|const) \($")
_TS_RULES = tuple(
    (re.compile(r"\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?" + p), kind)
    for p, kind in ((rf"(?:async\s+)?function\s*\*?\s*({_ID})", "func"), (rf"(?:abstract\s+)?class\s+({_ID})", "class"), (rf"interface\s+({_ID})", "interface"), (rf"(?:const\s+)?enum\s+({_ID})", "enum"), (rf"type\s+({_ID})[^=\n]*=", "type"), (rf"(?:const|let)\s+({_ID})", "const"))
)
_TS_METHOD = re.compile(rf"\s*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*(#?{_ID})\s*(?:<[^>]*>)?\(")
_NO_METHODS = frozenset({"if", "for", "while", "switch", "catch", "function", "return", "super", "new"})
_SHELL_FUNC = re.compile(rf"\s*(?:function\s+({_ID})\s*(?:\(\s*\))?|({_ID})\s*\(\s*\))\s*(?=[{{(]|$)")


def _end(code: Code, depths: list[int], line: int) -> int:
    """The last line of what starts on a line: brackets are closed again, and no brace opens on the next one."""
    base = depths[line - 1]
    at = line
    while at < len(code.lines) and (depths[at] > base or at in code.joined or (re.match(r"\s*\{", code.lines[at]) and depths[at] == base and at == line and "{" not in code.lines[line - 1])):
        at += 1
    return at


def _go(code: Code) -> Iterator[Declaration]:
    depths, block = code.depths(), None
    for number, line in enumerate(code.lines, 1):
        top = depths[number - 1] == 0
        if top:
            block = None
        if top and (m := _GO_FUNC.match(line)):
            yield Declaration(m[2], "method" if m[1] else "func", number, _end(code, depths, number), m[1], code.doc(number))
        elif top and (m := _GO_BLOCK.match(line.rstrip())):
            block = m[1]
        elif top and (m := _GO_ONE.match(line)) or (not top and block and depths[number - 1] == 1 and (m := re.match(r"\s+()(\w+(?:, *\w+)*)", line))):
            for name in re.split(", *", m[2]):
                yield Declaration(name, m[1] or block, number, _end(code, depths, number), None, code.doc(number))


def _typescript(code: Code) -> Iterator[Declaration]:
    depths = code.depths()
    open_: list[tuple[Declaration, int]] = []
    for number, line in enumerate(code.lines, 1):
        while open_ and number > open_[-1][0].end_line:
            open_.pop()
        owner, inside = open_[-1] if open_ else (None, -1)
        found = next(((m[1], kind) for rule, kind in _TS_RULES if (m := rule.match(line))), None)
        if found is None and owner is not None and owner.kind == "class" and depths[number - 1] == inside + 1 and (m := _TS_METHOD.match(line)) and m[1] not in _NO_METHODS and _has_body(code, depths, number):
            found = m[1], "method"
        if found is None or (found[1] == "const" and depths[number - 1] > 0):
            continue
        declared = Declaration(found[0], found[1], number, _end(code, depths, number), owner.name if owner else None, code.doc(number))
        yield declared
        if declared.kind in ("class", "func", "method"):
            open_.append((declared, depths[number - 1]))


def _has_body(code: Code, depths: list[int], line: int) -> bool:
    return "{" in "".join(code.lines[line - 1 : _end(code, depths, line)])


def _shell(code: Code) -> Iterator[Declaration]:
    depths = code.depths()
    open_: list[Declaration] = []
    for number, line in enumerate(code.lines, 1):
        while open_ and number > open_[-1].end_line:
            open_.pop()
        if m := _SHELL_FUNC.match(line):
            declared = Declaration(m[1] or m[2], "func", number, _end(code, depths, number), open_[-1].name if open_ else None, code.doc(number))
            yield declared
            open_.append(declared)


def _python(node: ast.AST, owner: str | None = None) -> Iterator[Declaration]:
    for child in ast.iter_child_nodes(node):
        if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            doc = ast.get_docstring(child)
            yield Declaration(child.name, "class" if isinstance(child, ast.ClassDef) else "func", child.lineno, child.end_lineno, owner, doc.split("\n")[0] if doc else None)
            yield from _python(child, child.name)
        else:
            yield from _python(child, owner)


_READERS = {"go": _go, "typescript": _typescript, "shell": _shell}


def declarations(text: str, language: str) -> list[Declaration]:
    """All declarations of a file, in order of their lines; a Python file that does not parse raises SyntaxError."""
    if language == "python":
        return sorted(_python(ast.parse(text)), key=lambda d: d.line)
    return list(_READERS[language](Code(text, language)))


# ---- imports and exports -------------------------------------------------------------------------------------------

_TS_EXPORT = re.compile(rf"export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?|class|interface|type|enum|const|let)\s+({_ID})")


def imports(text: str, language: str) -> list[tuple[str, int]]:
    """(name, line) of what a file imports."""
    if language == "python":
        found = ((a.name, n.lineno) for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Import) for a in n.names)
        return [*found, *((n.module or ".", n.lineno) for n in ast.walk(ast.parse(text)) if isinstance(n, ast.ImportFrom))]
    code, raw = Code(text, language), text.split("\n")
    out: list[tuple[str, int]] = []
    block = False
    for number, (line, whole) in enumerate(zip(code.lines, raw), 1):
        if language == "go":
            # the path is a string, which is blank in the code; the line around it is not
            m = re.match(r'\s*import\s+(?:[\w.]+\s+)?"([^"]+)"', whole) if line.startswith("import") else re.match(r'\s*(?:[\w.]+\s+)?"([^"]+)"', whole) if block else None
            block = (block or re.match(r"import\s*\(", line) is not None) and not line.lstrip().startswith(")")
        elif language == "typescript":
            m = re.match(r"\s*(?:import|export)\b.*?\bfrom\s*['\"]([^'\"]+)['\"]|\s*import\s*['\"]([^'\"]+)['\"]|\s*}.*?\bfrom\s*['\"]([^'\"]+)['\"]", whole) if re.match(r"\s*(?:import|export|})", line) else None
        else:
            m = re.match(r"\s*(?:source|\.)\s+(\S+)", whole) if re.match(r"\s*(?:source|\.)\s", line) else None
        if m:
            out.append((next(g for g in m.groups() if g), number))
    return out


def exports(text: str) -> list[tuple[str, int]]:
    """(name, line) of what a TypeScript file exports by a declaration."""
    code = Code(text, "typescript")
    return [(m[1], n) for n, line in enumerate(code.lines, 1) if (m := _TS_EXPORT.match(line))]
