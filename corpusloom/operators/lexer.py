"""One pass over the text of a source file: tokens with their bracket pairs, and the declarations among them.

Strings, comments, regular expression literals and nested templates are recognised while scanning, so what they hold is
never taken for code. Brackets are paired on a stack; a declaration's end is that of its body or of its statement.
Python files go through the standard library's own parser, and through their indented lines if it rejects them.
"""

from __future__ import annotations

import ast
import re
import warnings
from dataclasses import dataclass, field

JS_FAMILY = ("javascript", "typescript", "tsx")
_OPEN = {"(": ")", "[": "]", "{": "}", "${": "}"}
_CLOSE = frozenset(")]}")

_COMMENT = r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'"
_REST = r"(?P<word>[^\W\d][\w$]*|[$#][\w$]+)|(?P<num>\d[\w.]*)|(?P<op>=>|\+\+|--|\?\.|\S)"
_SCANNERS = {
    "js": re.compile(rf"(?P<skip>\s+|{_COMMENT})|(?P<str>{_DOUBLE}|{_SINGLE})|(?P<tick>`)|{_REST}"),
    "java": re.compile(rf'(?P<skip>\s+|{_COMMENT})|(?P<str>"""(?s:(?:[^"\\]|\\.|"(?!""))*)(?:"""|\Z)|{_DOUBLE}|{_SINGLE})|{_REST}'),
    "go": re.compile(rf"(?P<skip>\s+|{_COMMENT})|(?P<str>{_DOUBLE}|`[^`]*(?:`|\Z)|{_SINGLE})|{_REST}"),
}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\(?s:.)|\\\Z|\$(?!\{))*(?P<end>`|\$\{|\Z)")
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do yield await".split())


@dataclass
class Facts:
    """What a file declares: symbols (name, kind, start, end, parent), imports (module, line, level, names)."""

    symbols: list[tuple] = field(default_factory=list)
    imports: list[tuple] = field(default_factory=list)
    package: str | None = None
    errors: bool = False

    def add(self, name: str, kind: str, start: int, end: int, parent: str | None = None) -> None:
        if name:
            self.symbols.append((name, kind, start, end, parent))


class Tokens:
    """Kinds (str, word, num, op), texts and lines of the tokens of a file, and the partner of each bracket."""

    def __init__(self, text: str, family: str) -> None:
        self.kind, self.text, self.line, self.last_line, self.at = [], [], [], [], []
        self.pair: dict[int, int] = {}
        self.source, self.balanced = text, True
        scan, stack, pos, line = _SCANNERS[family], [], 0, 1
        while pos < len(text):
            m = scan.match(text, pos)
            kind, value = m.lastgroup, m.group()
            if kind == "skip":
                pos, line = m.end(), line + value.count("\n")
                continue
            if kind == "tick":
                kind, value = "str", "`" + _TEMPLATE.match(text, pos + 1).group()
            elif kind == "op" and value == "/" and family == "js" and self._regex_may_start() and (r := _REGEX.match(text, pos)):
                kind, value = "str", r.group()
            if kind == "op" and value in _CLOSE:
                if stack and _OPEN[self.text[stack[-1]]] == value:
                    begin = stack.pop()
                    self.pair[begin] = len(self.text)
                    if self.text[begin] == "${":
                        value += _TEMPLATE.match(text, pos + 1).group()
                else:
                    self.balanced = False
            self._push(kind, value, line, pos)
            if kind == "op" and value in _OPEN:
                stack.append(len(self.text) - 1)
            pos, line = pos + len(value), line + value.count("\n")
            self.last_line[-1] = line
            if value.endswith("${") and (value[0] in "`}"):
                self._push("op", "${", line, pos)
                stack.append(len(self.text) - 1)
        self.balanced = self.balanced and not stack
        for begin in stack:
            self.pair[begin] = len(self.text)

    def _push(self, kind: str, value: str, line: int, pos: int) -> None:
        for items, x in ((self.kind, kind), (self.text, value), (self.line, line), (self.last_line, line), (self.at, pos)):
            items.append(x)

    def _regex_may_start(self) -> bool:
        if not self.text:
            return True
        kind, value = self.kind[-1], self.text[-1]
        return value in _BEFORE_REGEX if kind == "word" else kind == "op" and value[0] not in ")]}"

    def __len__(self) -> int:
        return len(self.text)

    def word(self, i: int, *texts: str) -> bool:
        return i < len(self.text) and self.kind[i] == "word" and (not texts or self.text[i] in texts)

    def op(self, i: int, *texts: str) -> bool:
        return i < len(self.text) and self.kind[i] == "op" and self.text[i] in texts

    def after(self, i: int) -> int:
        """The place behind token ``i``, and behind its partner if it opens a bracket."""
        return self.pair[i] + 1 if i in self.pair else i + 1

    def end_line(self, i: int) -> int:
        return self.last_line[min(i, len(self.text) - 1)]

    def past_angles(self, i: int, stop: int) -> int:
        """Behind the type arguments that start at ``i`` (``i`` itself if there are none)."""
        if not self.op(i, "<"):
            return i
        depth = 0
        while i < stop:
            depth += self.op(i, "<") - self.op(i, ">")
            i = self.after(i)
            if not depth:
                break
        return i

    def past_notes(self, i: int, stop: int) -> int:
        """Behind annotations or decorators: ``@name.name(...)``."""
        while i < stop and self.op(i, "@") and not self.word(i + 1, "interface"):
            i += 2
            while self.op(i, "."):
                i += 2
            if self.op(i, "("):
                i = self.after(i)
        return i


# --- JavaScript and TypeScript ------------------------------------------------------------------

_NO_END = frozenset("= => , . ? ?. : + - * / % & | ^ < ! ~ ( [ { @".split())
_NO_START = frozenset("= => , . ? ?. : + - * / % & | ^ < > ) ] } ( [ ; !".split())
_GO_ON = frozenset("instanceof in of as satisfies else catch finally extends implements".split())
_JS_MODIFIERS = "public private protected static async readonly override abstract declare get set accessor".split()


class Script:
    def __init__(self, text: str) -> None:
        self.t, self.facts = Tokens(text, "js"), Facts()

    def run(self) -> Facts:
        t, i = self.t, 0
        while i < len(t):
            i = max(self.statement(i), i + 1)
        self.imports()
        self.facts.errors = not t.balanced
        return self.facts

    def breaks(self, i: int) -> bool:
        """Whether a statement may end between the tokens ``i - 1`` and ``i``, because a new line starts there."""
        t = self.t
        if t.line[i] == t.last_line[i - 1] or (t.kind[i - 1] == "op" and t.text[i - 1] in _NO_END):
            return False
        return not (t.text[i] in _GO_ON if t.kind[i] == "word" else t.kind[i] == "op" and t.text[i] in _NO_START)

    def expression(self, i: int, stop: int) -> int:
        """Behind the last token of the expression or type at ``i``: at a comma, a semicolon or a new statement."""
        first = i
        while i < stop and not self.t.op(i, ";", ","):
            if i > first and self.breaks(i):
                break
            i = self.t.after(i)
        return min(i, stop)

    def ended(self, i: int, stop: int) -> int:
        """Behind the statement at ``i``, its semicolon included."""
        i = self.expression(i, stop)
        while self.t.op(i, ",") and i < stop:
            i = self.expression(i + 1, stop)
        return i + 1 if self.t.op(i, ";") else i

    def body(self, i: int, stop: int) -> int:
        """Behind the function whose parameters open at or after ``i``; without a body behind its signature."""
        t = self.t
        while i < stop and not t.op(i, "("):
            i = t.past_angles(i, stop) if t.op(i, "<") else i + 1
        i = t.after(i) if i < stop else i
        if t.op(i, ":"):
            i += 1
            while i < stop and not t.op(i, ";", "}"):
                if t.op(i, "{") and not (t.kind[i - 1] == "op" and t.text[i - 1] in (":", "|", "&", "=>", "<", ",")):
                    break
                if t.line[i] != t.last_line[i - 1] and self.breaks(i):
                    return i
                i = t.after(i)
        if t.op(i, "{"):
            return t.after(i)
        return i + 1 if t.op(i, ";") else i

    def value(self, i: int, stop: int) -> tuple[str | None, int]:
        """``function`` or ``class``, if the value at ``i`` is one, and where the rest of its expression starts."""
        t, first = self.t, i
        if t.word(i, "async") and not t.op(i + 1, "=>"):
            i += 1
        if t.word(i, "function", "class"):
            return t.text[i], first
        if t.word(i) and t.op(i + 1, "=>"):
            return "function", i + 2
        i = t.past_angles(i, stop)
        if not t.op(i, "("):
            return None, first
        i = t.after(i)
        if t.op(i, ":"):
            i += 1
            while i < stop and not t.op(i, "=>", ";", "=", ")"):
                i = t.after(i)
        return ("function", i + 1) if t.op(i, "=>") else (None, first)

    def past_type(self, i: int, stop: int) -> int:
        """Behind an optional type: at ``=``, a comma, a semicolon or a new statement."""
        t = self.t
        while t.op(i, "?", "!"):
            i += 1
        if not t.op(i, ":"):
            return i
        i += 1
        while i < stop and not t.op(i, "=", ",", ";") and not self.breaks(i):
            i = t.past_angles(i, stop) if t.op(i, "<") else t.after(i)
        return i

    def statement(self, i: int) -> int:
        t, facts, stop = self.t, self.facts, len(self.t)
        start = t.line[i]
        k = t.past_notes(i, stop)
        exported = default = False
        if t.word(k, "export"):
            exported, k = True, k + 1
            if t.word(k, "default"):
                default, k = True, k + 1
            k = t.past_notes(k, stop)
        while t.word(k, "declare", "abstract", "async") and t.word(k + 1) and t.line[k] == t.line[k + 1]:
            k += 1
        if t.word(k, "const") and t.word(k + 1, "enum"):
            k += 1
        word = t.text[k] if t.word(k) else ""
        if word == "function":
            name = k + 2 if t.op(k + 1, "*") else k + 1
            end = self.body(k + 1, stop)
            if t.word(name) or default:
                facts.add(t.text[name] if t.word(name) else "default", "function", start, t.end_line(end - 1))
            return end
        if word == "class":
            return self.type_with_members(k, start, stop, "default" if default else "")
        if word in ("interface", "enum") and t.word(k + 1):
            end = k + 1
            while end < stop and not t.op(end, "{"):
                end = t.past_angles(end, stop) if t.op(end, "<") else t.after(end)
            end = t.after(end) if end < stop else end
            facts.add(t.text[k + 1], word, start, t.end_line(end - 1))
            return end
        if word == "type" and t.word(k + 1) and t.line[k] == t.line[k + 1]:
            name = t.text[k + 1]
            end = self.ended(t.past_angles(k + 2, stop), stop)
            facts.add(name, "type", start, t.end_line(end - 1))
            return end
        if word in ("const", "let", "var"):
            return self.variables(k + 1, start, stop)
        if default:
            kind, rest = self.value(k, stop)
            end = self.ended(rest, stop)
            if kind:
                facts.add("default", kind, start, t.end_line(end - 1))
            return end
        return self.ended(k, stop) if not exported or k < stop else stop

    def variables(self, i: int, start: int, stop: int) -> int:
        t, found = self.t, []
        while i < stop:
            name = i
            i = self.past_type(t.after(i), stop)
            if t.op(i, "="):
                kind, rest = self.value(i + 1, stop)
                found.append((name, i + 1, kind))
                i = self.expression(rest, stop)
            if not t.op(i, ","):
                break
            i += 1
        end = i + 1 if t.op(i, ";") else i
        for name, value, kind in found:
            text = t.source[t.at[name] : t.at[name] + len(t.text[name])]
            if kind == "class":
                self.type_with_members(value, start, stop, text, t.end_line(end - 1))
            elif kind:
                self.facts.add(text, "function", start, t.end_line(end - 1))
        return end

    def type_with_members(self, k: int, start: int, stop: int, name: str, end_line: int | None = None) -> int:
        """The class whose keyword stands at ``k``; ``name`` is used where it has none of its own (or is a value)."""
        t, i = self.t, k + 1
        own = t.text[i] if t.word(i) and not t.word(i, "extends", "implements") else ""
        name = name if end_line else own or name
        while i < stop and not t.op(i, "{"):
            i = t.past_angles(i, stop) if t.op(i, "<") else t.after(i)
        end = t.after(i) if i < stop else i
        self.facts.add(name, "class", start, end_line or t.end_line(end - 1))
        if name and (own or end_line) and i < stop:
            self.members(i + 1, t.pair[i], name)
        return end

    def members(self, i: int, stop: int, owner: str) -> None:
        t = self.t
        while i < stop:
            i = t.past_notes(i, stop)
            start = i
            while t.word(i, *_JS_MODIFIERS) and i + 1 < stop and not t.op(i + 1, "(", "=", ";", ":", "?", "!", "<", "}"):
                i += 1
            if t.op(i, "*"):
                i += 1
            if i >= stop or t.op(i, ";", "{"):
                i = t.after(i)
                continue
            name, i = i, t.after(i)
            text = t.source[t.at[name] : t.at[i - 1] + len(t.text[i - 1])]
            while t.op(i, "?", "!"):
                i += 1
            paren = t.past_angles(i, stop)
            if t.op(paren, "(") and paren < stop:
                i = self.body(paren, stop)
                last = i - 2 if t.op(i - 1, ";") else i - 1
                self.facts.add(text, "method", t.line[start], t.end_line(last), owner)
                continue
            i = self.past_type(i, stop)
            if t.op(i, "="):
                kind, rest = self.value(i + 1, stop)
                i = self.expression(rest, stop)
                if kind == "function":
                    self.facts.add(text, "method", t.line[start], t.end_line(i - 1), owner)
            i += 1 if i < stop and t.op(i, ";", ",") else 0
            i = max(i, name + 1)

    def imports(self) -> None:
        t, begin = self.t, 0
        for i in range(len(t)):
            if t.word(i, "import", "export") and not t.op(i + 1, ".", "(") and (i == 0 or self.breaks(i) or t.op(i - 1, ";", "}")):
                begin = i
                if t.word(i, "import") and i + 1 < len(t) and t.kind[i + 1] == "str":
                    self._import(t.text[i + 1], t.line[i])
            elif t.word(i, "from") and i + 1 < len(t) and t.kind[i + 1] == "str" and t.word(begin, "import", "export"):
                self._import(t.text[i + 1], t.line[begin])
            elif t.word(i, "require", "import") and t.op(i + 1, "(") and not t.op(i - 1, "."):
                end = t.pair[i + 1]
                if end == i + 3 or (end == i + 4 and t.op(i + 3, ",")):
                    if t.kind[i + 2] == "str" and t.text[i + 2][0] in "'\"`" and not t.text[i + 2].endswith("${"):
                        self._import(t.text[i + 2], t.line[i])

    def _import(self, quoted: str, line: int) -> None:
        module = quoted.strip("'\"`")
        if module:
            self.facts.imports.append((module, line, 0, []))


# --- Java ---------------------------------------------------------------------------------------

_JAVA_MODIFIERS = "public protected private static final abstract synchronized native default strictfp sealed transient volatile".split()
_JAVA_KINDS = {"class": "class", "interface": "interface", "enum": "enum", "record": "class"}


class Java:
    def __init__(self, text: str) -> None:
        self.t, self.facts = Tokens(text, "java"), Facts()

    def run(self) -> Facts:
        self.members(0, len(self.t), None, "file")
        self.facts.errors = not self.t.balanced
        return self.facts

    def modifiers(self, i: int, stop: int) -> int:
        t = self.t
        while i < stop:
            if t.op(i, "@") and not t.word(i + 1, "interface"):
                i = t.past_notes(i, stop)
            elif t.word(i, *_JAVA_MODIFIERS):
                i += 1
            elif t.word(i, "non") and t.op(i + 1, "-"):
                i += 3
            else:
                break
        return i

    def until(self, i: int, stop: int, *marks: str) -> int:
        while i < stop and not self.t.op(i, *marks):
            i = self.t.past_angles(i, stop) if self.t.op(i, "<") else self.t.after(i)
        return i

    def members(self, i: int, stop: int, owner: str | None, kind: str) -> None:
        t = self.t
        while i < stop:
            start, k = i, self.modifiers(i, stop)
            note = t.op(k, "@")
            k += note
            word = t.text[k] if t.word(k) else ""
            if word in ("package", "import") and owner is None:
                end = self.until(k, stop, ";")
                words = t.text[k + 1 : end]
                if word == "package":
                    self.facts.package = "".join(words)
                else:
                    self.facts.imports.append(("".join(words[words[:1] == ["static"] :]), t.line[k], 0, []))
                i = end + 1
            elif word in _JAVA_KINDS and t.word(k + 1) and (word != "record" or t.op(k + 2, "(", "<")):
                name, body = t.text[k + 1], self.until(k + 2, stop, "{", ";")
                i = t.after(body) if body < stop else stop
                self.facts.add(name, "interface" if note else _JAVA_KINDS[word], t.line[start], t.end_line(i - 1), owner)
                if body < stop and t.op(body, "{") and word != "enum":
                    self.members(body + 1, t.pair[body], name, "note" if note else word)
            elif owner is None:
                i = max(self.until(k, stop, ";", "{"), k)
                i = t.after(i) if i < stop else stop
            else:
                i = self.member(start, k, stop, owner, kind)

    def member(self, start: int, k: int, stop: int, owner: str, kind: str) -> int:
        t = self.t
        first = t.past_angles(k, stop)
        i = first
        while i < stop and not t.op(i, "(", ";", "=", "{"):
            i = t.past_angles(i, stop) if t.op(i, "<") else t.after(i)
        if t.op(i, "(") and i < stop and t.word(i - 1) and (i - 1 > first or t.text[i - 1] == owner):
            end = self.until(t.after(i), stop, "{", ";")
            end = t.after(end) if end < stop else stop
            if kind != "note":
                self.facts.add(t.text[i - 1], "method", t.line[start], t.end_line(end - 1), owner)
            return end
        if t.op(i, "{") and i < stop:
            return t.after(i)
        while i < stop and not t.op(i, ";"):
            i = t.after(i)
        return i + 1


# --- Go -----------------------------------------------------------------------------------------


class Go:
    def __init__(self, text: str) -> None:
        self.t, self.facts = Tokens(text, "go"), Facts()

    def run(self) -> Facts:
        t, i = self.t, 0
        while i < len(t):
            end = self.line_end(i, len(t))
            word = t.text[i] if t.word(i) else ""
            if word == "package" and t.word(i + 1):
                self.facts.package = t.text[i + 1]
            elif word == "import":
                inside = range(i + 2, t.pair[i + 1]) if t.op(i + 1, "(") else range(i + 1, end)
                self.facts.imports += [(t.text[k].strip("\"'`"), t.line[k], 0, []) for k in inside if t.kind[k] == "str"]
            elif word == "func":
                end = self.function(i)
            elif word == "type" and t.op(i + 1, "("):
                specs, k = [], i + 2
                while k < t.pair[i + 1]:
                    stop = self.line_end(k, t.pair[i + 1])
                    specs.append((k, stop))
                    k = stop + 1 if t.op(stop, ";") else stop
                end = t.after(i + 1)
                for k, stop in specs:
                    alone = len(specs) == 1
                    self.spec(k, t.line[i if alone else k], t.end_line((end if alone else stop) - 1))
            elif word == "type":
                self.spec(i + 1, t.line[i], t.end_line(end - 1))
            i = max(end, i + 1)
        self.facts.errors = not t.balanced
        return self.facts

    def line_end(self, i: int, stop: int) -> int:
        """Behind the statement at ``i``: a new line ends it outside of brackets, unless an operator or a comma waits."""
        t = self.t
        i = t.after(i)
        while i < stop and not t.op(i, ";"):
            if t.line[i] != t.last_line[i - 1] and not (t.kind[i - 1] == "op" and t.text[i - 1] in "=,.+-*/&|^<>!:%"):
                break
            i = t.after(i)
        return min(i, stop)

    def spec(self, k: int, start: int, end: int) -> None:
        t = self.t
        if not t.word(k):
            return
        i = k + 1
        if t.op(i, "[") and t.word(i + 1) and t.pair[i] > i + 2:
            i = t.after(i)
        if t.op(i, "="):
            i += 1
        self.facts.add(t.text[k], t.text[i] if t.word(i, "struct", "interface") else "type", start, end)

    def function(self, i: int) -> int:
        t, stop, k, owner = self.t, len(self.t), i + 1, None
        method = t.op(k, "(")
        if method:
            close = t.pair[k]
            bracket = next((j for j in range(k + 1, close) if t.op(j, "[")), close)
            words = [t.text[j] for j in range(k + 1, bracket) if t.word(j)]
            owner = words[-1] if words else None
            k = t.after(k)
        name, k = (t.text[k] if t.word(k) else ""), k + 1
        while k < stop and not (t.op(k, "{") and not t.word(k - 1, "struct", "interface")):
            if t.line[k] != t.last_line[k - 1]:
                break
            k = t.after(k)
        end = t.after(k) if t.op(k, "{") else k
        self.facts.add(name, "method" if method else "function", t.line[i], t.end_line(end - 1), owner)
        return end


# --- Python -------------------------------------------------------------------------------------


def python_facts(text: str) -> Facts:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _by_indent(text)
    facts = Facts()
    for node in tree.body:
        _declared(node, None, facts)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            facts.imports += [(a.name, node.lineno, 0, []) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and (node.level or node.module != "__future__"):
            names = [a.name for a in node.names if a.name != "*"]
            facts.imports.append((node.module or "", node.lineno, node.level, names))
    facts.imports.sort(key=lambda x: x[1])
    return facts


def _declared(node: ast.AST, owner: str | None, facts: Facts) -> None:
    if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
        return
    start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
    is_class = isinstance(node, ast.ClassDef)
    facts.add(node.name, "class" if is_class else "method" if owner else "function", start, node.end_lineno, owner)
    if is_class and owner is None:
        for child in node.body:
            _declared(child, node.name, facts)


_PY_LITERAL = re.compile(r'"""(?s:.*?)(?:"""|\Z)|\'\'\'(?s:.*?)(?:\'\'\'|\Z)|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|#[^\n]*')
_PY_HEAD = re.compile(r"(?:async\s+)?(def|class)\s+(\w+)")
_PY_IMPORT = re.compile(r"import\s+(.+)|from\s*(\.*)\s*([\w.]*)\s*import\s*\(?([^)]*)")


def _by_indent(text: str) -> Facts:
    """Declarations of a file that doesn't parse, by the indentation of its logical lines."""
    plain = _PY_LITERAL.sub(lambda m: '""' + "\n" * m.group().count("\n") if m.group()[0] != "#" else "", text.replace("\t", " " * 8))
    facts, lines, depth, rows = Facts(errors=True), plain.split("\n"), 0, []
    for number, line in enumerate(lines, 1):
        code = line.rstrip()
        if not code.strip():
            continue
        if depth or (rows and rows[-1][2].endswith("\\")):
            rows[-1][1], rows[-1][2] = number, rows[-1][2].rstrip("\\") + " " + code.strip()
        else:
            rows.append([number, number, code, len(code) - len(code.lstrip())])
        depth = max(0, depth + sum(code.count(c) for c in "([{") - sum(code.count(c) for c in ")]}"))
    _blocks(rows, 0, None, facts)
    for first, _, code, _ in rows:
        for part in code.split(";"):
            m = _PY_IMPORT.match(part.strip())
            if m and m.group(1):
                facts.imports += [(x.split(" as ")[0].strip(), first, 0, []) for x in m.group(1).split(",")]
            elif m and (m.group(2) or m.group(3) not in ("", "__future__")):
                names = [n.split(" as ")[0].strip() for n in m.group(4).split(",")]
                facts.imports.append((m.group(3), first, len(m.group(2)), [n for n in names if n.isidentifier()]))
    return facts


def _blocks(rows: list, indent: int, owner: str | None, facts: Facts) -> None:
    heads = [i for i, row in enumerate(rows) if row[3] <= indent]
    start = None
    for i, after in zip(heads, [*heads[1:], len(rows)][: len(heads)], strict=True):
        start = rows[i][0] if start is None else start
        if rows[i][2].strip().startswith("@"):
            continue
        if m := _PY_HEAD.match(rows[i][2].strip()):
            kind = "class" if m.group(1) == "class" else "method" if owner else "function"
            facts.add(m.group(2), kind, start, rows[after - 1][1], owner)
            if kind == "class" and owner is None and after > i + 1:
                _blocks(rows[i + 1 : after], rows[i + 1][3], m.group(2), facts)
        start = None


def facts_of(language: str, text: str) -> Facts:
    """The facts of one file; a file that can't be read has none, and its ``errors`` is set."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    try:
        if language == "python":
            facts = python_facts(text)
        else:
            facts = (Script if language in JS_FAMILY else Java if language == "java" else Go)(text).run()
    except (RecursionError, IndexError, KeyError):
        return Facts(errors=True)
    facts.symbols.sort(key=lambda s: (s[2], -s[3]))
    return facts
