"""Tokens of source code, and what a single pass over them knows: definitions with their exact spans, and imports.

A scanner per language family leaves out comments and keeps strings whole, template texts with their nested expressions, nested
comments, raw and heredoc strings, character literals beside lifetimes, and regular expressions where a value may stand. The
pass holds a stack of open brackets; each bracket keeps the head of the statement that it is in (words and closed groups), and what
an opening brace starts is decided by that head. Everything is linear in the source, broken sources included.

What counts as a definition: functions, methods and arrow functions; classes, Go types, Rust structs, enums and impls. Bodies of
interfaces, traits, modules and anonymous classes are entered but are none themselves, nor are constructors of Java, function
expressions and generators.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

_LINE, _BLOCK = r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\[\s\S])*"?', r"'(?:[^'\\\n]|\\[\s\S])*'?"
_REST = r"(?P<w>[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*)|(?P<p>=>|::|->|\.\.\.|[^\w\s])"
_SCAN = {
    "js": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>{_DOUBLE}|{_SINGLE})|{_REST}",
    "java": rf'(?P<c>{_LINE}|{_BLOCK})|(?P<s>"""[\s\S]*?(?:"""|\Z)|{_DOUBLE}|{_SINGLE})|{_REST}',
    "go": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>`[^`]*`?|{_DOUBLE}|{_SINGLE})|{_REST}",
    "rust": rf"""(?P<c>{_LINE})|(?P<s>b?r(?P<q>\#*)"[\s\S]*?(?:"(?P=q)|\Z)|b?"(?:[^"\\]|\\[\s\S])*"?|b?'(?:[^'\\\n]|\\[^\n]?[^'\n]*)'|'\w+)|{_REST}""",
    "php": rf"(?P<c>{_BLOCK}|(?://|\#(?!\[))(?:(?!\?>)[^\n])*)|(?P<s><<<[ \t]*[\"']?(?P<q>\w+)[\"']?\n[\s\S]*?(?:\n[ \t]*(?P=q)\b|\Z)|\"(?:[^\"\\]|\\[\s\S])*\"?|'(?:[^'\\]|\\[\s\S])*'?)|{_REST}",
}
_SCAN = {k: re.compile(v) for k, v in _SCAN.items()}
FAMILY = {"javascript": "js", "typescript": "js", "tsx": "js", "java": "java", "go": "go", "rust": "rust", "php": "php"}
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_VALUE_AFTER = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield"}


class Token(NamedTuple):
    kind: str  # w word, s string, p punctuation
    text: str
    start: int
    end: int
    line: int


def tokens(source: str, language: str) -> list[Token]:
    family = FAMILY[language]
    scan, out = _SCAN[family], []
    at, line, seen = 0, 1, 0
    braces: list[str] = []

    def add(kind: str, start: int, end: int) -> None:
        nonlocal line, seen
        line += source.count("\n", seen, start)
        seen = start
        out.append(Token(kind, source[start:end], start, end, line))

    def template(start: int) -> int:
        """From a template's text on to its end or its next expression."""
        end = _TEMPLATE.match(source, start).end()
        if source.startswith("${", end):
            braces.append("template")
            return end + 2
        return min(end + 1, len(source))

    if family == "php":
        at = source.find("<?")
        at = len(source) if at < 0 else at + 2
    while at < len(source):
        if family == "rust" and source.startswith("/*", at):
            deep, to = 1, at + 2
            for m in re.compile(r"/\*|\*/").finditer(source, to):
                deep, to = deep + (1 if m[0] == "/*" else -1), m.end()
                if not deep:
                    break
            at = to if not deep else len(source)
            continue
        if family == "php" and source.startswith("?>", at):
            to = source.find("<?", at)
            add("p", at, at + 2)
            at = len(source) if to < 0 else to + 2
            continue
        char = source[at]
        if family == "js":
            if char == "`":
                to = template(at + 1)
                add("s", at, to)
                at = to
                continue
            if char == "}" and braces and braces.pop() == "template":
                at = template(at + 1)
                continue
            if char == "{":
                braces.append("{")
            if char == "/" and source[at + 1 : at + 2] not in ("/", "*"):
                last = out[-1] if out else None
                value = last is None or (last.kind == "p" and last.text not in ")]}") or last.text in _VALUE_AFTER
                if value and (m := _REGEX.match(source, at)):
                    add("s", at, m.end())
                    at = m.end()
                    continue
        m = scan.match(source, at)
        if m is None:
            at += 1
            continue
        if m.lastgroup != "c" and m["c"] is None:
            kind = "w" if m["w"] is not None else "p" if m["p"] is not None else "s"
            add(kind, m.start(), m.end())
        at = max(m.end(), at + 1)
    return out


@dataclass
class _Open:
    """An open bracket: its token, what its inside is, the definition that it ends, and the head of the statement it is in."""

    mark: str
    begin: int
    kind: str  # block, class, object, group, top
    made: tuple[int, str] | None = None
    head: list[Token] = field(default_factory=list)
    arrows: list[int] = field(default_factory=list)


#: What is looked at of a statement before a brace or an arrow, in tokens and closed groups; longer ones are data.
LONGEST_HEAD = 200
_CLOSE = {")": "(", "]": "[", "}": "{"}
_CONTROL = {"if", "for", "while", "switch", "catch", "with", "synchronized", "try", "foreach", "elseif", "match", "declare", "else", "do", "finally"}
_JS_MODIFIERS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "*", "#", "accessor"}
_RUST_MODIFIERS = {"pub", "()", "async", "unsafe", "const", "extern", "default"}


def _at(head: list[Token], *names: str) -> int:
    """Place of the last of some words in a head; -1 if there is none."""
    return max((i for i, t in enumerate(head) if t.kind == "w" and t.text in names), default=-1)


def _back(head: list[Token], i: int, words: set[str]) -> int:
    while i and head[i - 1].text in words:
        i -= 1
    return i


def _named(head: list[Token]) -> int:
    """Place of the name before the last parameter list of a head, over generics; -1 if it is none."""
    groups = [i for i, t in enumerate(head) if t.kind == "g" and t.text == "()"]
    if not groups:
        return -1
    i = groups[-1] - 1
    if i >= 0 and head[i].text == ">":
        deep = 0
        while i >= 0:
            deep += (head[i].text == ">") - (head[i].text == "<")
            i -= 1
            if not deep:
                break
    return i if i >= 0 and (head[i].kind in "ws" or head[i].text == "[]") else -1


def _js(head: list[Token], inside: str) -> tuple[str, tuple[int, str] | None]:
    texts = [t.text for t in head]
    if head and texts[-1] == "=>":
        return "block", None  # the arrow itself is held apart
    c = _at(head, "class")
    if c >= 0 and "=>" not in texts[c:]:
        before = head[c - 1] if c else None
        starts = before is None or before.text in ("export", "default") or before.line < head[c].line and before.kind in "wsg"
        return "class", (head[c].start, "class") if starts else None
    if _at(head, "interface", "namespace", "module") >= 0 and inside in ("top", "block"):
        return "block", None
    f = _at(head, "function")
    if f >= 0:
        i = f - 1 if f and texts[f - 1] == "async" else f
        before = head[i - 1] if i else None
        starts = before is None or before.text in ("export", "default") or before.line < head[i].line and before.kind in "wsg"
        star = f + 1 < len(head) and texts[f + 1] == "*"
        return "block", (head[i].start, "function") if starts and not star and inside in ("top", "block") else None
    n = _named(head)
    if inside in ("class", "object") and n >= 0 and texts[n] not in _CONTROL and "=" not in texts[n:] and ":" not in texts[max(0, n - 1) : n]:
        return "block", (head[_back(head, n, _JS_MODIFIERS)].start, "function")
    if not head or head[0].text in _CONTROL or texts[-1] == "()" or head[-1].kind == "w" and texts[-1] in _CONTROL:
        return "block", None
    if inside == "class" and texts[-1] == "static":
        return "block", None
    return "object", None


def _java(head: list[Token], inside: str) -> tuple[str, tuple[int, str] | None]:
    texts = [t.text for t in head]
    c = _at(head, "class", "interface", "enum", "record")
    if c >= 0 and texts[c - 1 : c] != ["."] and "=" not in texts[:c] and "new" not in texts[:c]:
        return "class", (head[0].start, "class") if texts[c] == "class" else None
    if "new" in texts and texts[-1] == "()" or inside == "class" and len(head) == 1 and head[0].kind == "w" and texts[0] != "static":
        return "class", None  # an anonymous class, or the body of a constant
    if inside == "class" and "=" not in texts and (n := _named(head)) > 0 and texts[n - 1] not in ("new", "."):
        typed = head[n - 1].kind in "wg" or texts[n - 1] in (">", "]")
        typed = typed and texts[n - 1] not in ("public", "private", "protected", "()")
        return "block", (head[0].start, "function") if typed else None
    return ("object", None) if "=" in texts or texts[-1:] == ["[]"] else ("block", None)


def _php(head: list[Token], inside: str) -> tuple[str, tuple[int, str] | None]:
    texts = [t.text for t in head]
    c = _at(head, "class", "interface", "trait", "enum")
    if c >= 0 and texts[c - 1 : c] not in (["::"], ["new"]) and "new" not in texts[:c]:
        return "class", (head[0].start, "class") if texts[c] == "class" else None
    if "new" in texts and _at(head, "class") >= 0:
        return "class", None
    f = _at(head, "function")
    if f >= 0 and f + 1 < len(head) and any(t.kind == "w" for t in head[f + 1 : f + 3]) and "=" not in texts[:f]:
        return "block", (head[0 if inside == "class" else f].start, "function")
    return "block", None


def _go(head: list[Token], inside: str) -> tuple[str, tuple[int, str] | None]:
    first = head[0].text if head else ""
    if first == "func" and inside == "top":
        return "block", (head[0].start, "function")
    if first == "type":
        return "object", None  # a type's declaration ends with its line
    return "block", None


def _rust(head: list[Token], inside: str) -> tuple[str, tuple[int, str] | None]:
    f = _at(head, "fn")
    if f >= 0 and f + 1 < len(head) and head[f + 1].kind == "w":
        i = f
        while i and (head[i - 1].text in _RUST_MODIFIERS or head[i - 1].kind == "s"):
            i -= 1
        return "block", (head[i].start, "function")
    for name in ("impl", "struct", "enum", "union"):
        i = next((k for k, t in enumerate(head) if t.text == name and t.kind == "w"), -1)
        if i >= 0 and all(t.text in _RUST_MODIFIERS for t in head[:i]):
            return "class", (head[0].start, "class") if name != "union" else None
    return "block", None


_HEADS = {"js": _js, "java": _java, "php": _php, "go": _go, "rust": _rust}


def _ended(family: str, head: list[Token], inside: str) -> tuple[int, str] | None:
    """The definition that a statement without a body is, at its end."""
    texts = [t.text for t in head]
    if not head:
        return None
    if family == "go" and texts[0] == "type" and len(head) > 1:
        return head[0].start, "class"
    if family == "rust" and "struct" in texts and all(x in _RUST_MODIFIERS for x in texts[: texts.index("struct")]):
        return head[0].start, "class"
    if family == "java" and inside == "class" and "=" not in texts and (n := _named(head)) > 0 and head[n - 1].kind in "wg" and texts[n - 1] not in ("public", "private", "protected", "()"):
        return head[0].start, "function"
    if family == "php" and inside == "class" and (f := _at(head, "function")) >= 0 and f + 1 < len(head):
        return head[0].start, "function"
    return None


def definitions(source: str, language: str, toks: list[Token] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, function or class) of the definitions of a source, outer ones first."""
    family, toks = FAMILY[language], tokens(source, language) if toks is None else toks
    found: list[tuple[int, int, str]] = []
    stack = [_Open("", 0, "top")]
    last: Token | None = None

    def arrows(frame: _Open, end: int) -> None:
        found.extend((a, end, "function") for a in frame.arrows)
        frame.arrows = []

    def finish(frame: _Open, end: int) -> None:
        arrows(frame, last.end if last else end)
        if made := _ended(family, frame.head, frame.kind):
            found.append((made[0], end, made[1]))
        frame.head = []

    for t in toks:
        frame = stack[-1]
        later = last is not None and t.line > last.line
        closed = last is not None and (last.kind in "ws" or last.text in ")]}")
        if family == "go" and later and closed and frame.mark in ("", "{"):
            finish(frame, last.end)
        elif family == "js" and later and closed and t.kind == "w" and t.text not in ("in", "instanceof", "of") and frame.kind in ("top", "block", "class"):
            arrows(frame, last.end)
        if t.kind == "p" and t.text in ("(", "[", "{"):
            kind, made = ("group", None) if t.text != "{" else _HEADS[family](frame.head[-LONGEST_HEAD:], frame.kind)
            if t.text == "{" and family == "js" and frame.head and frame.head[-1].text == "=>" and frame.arrows:
                made = (frame.arrows.pop(), "function")
            stack.append(_Open(t.text, t.start, kind, made))
        elif t.kind == "p" and t.text in _CLOSE:
            while len(stack) > 1 and stack[-1].mark != _CLOSE[t.text] and any(f.mark == _CLOSE[t.text] for f in stack):
                arrows(stack.pop(), last.end if last else t.start)
            if stack[-1].mark == _CLOSE[t.text]:
                own = stack.pop()
                arrows(own, last.end)
                if own.head and (family == "go" or own.kind == "class"):
                    finish(own, last.end)
                outer = stack[-1]
                if own.made:
                    found.append((own.made[0], t.end, own.made[1]))
                whole = own.kind in ("block", "class") and own.mark == "{" and not (family == "js" and outer.head and outer.head[-1].text == "=>") and not (family == "go" and outer.head[:1] and outer.head[0].text != "func")
                if whole and (own.made or outer.kind in ("top", "block", "class")):
                    outer.head = []
                else:
                    outer.head.append(Token("g", own.mark + t.text, own.begin, t.end, t.line))
                if family == "rust" and own.mark == "[" and len(outer.head) >= 2 and outer.head[-2].text in ("#", "!"):
                    outer.head = []  # an attribute
        elif t.text == ";" or t.text == "?>" or (t.text == "," and frame.kind in ("group", "object") and family in ("js", "php")):
            finish(frame, t.end)
        else:
            if t.text == "=>" and family in ("js", "php"):
                head = frame.head[-LONGEST_HEAD:]
                i = _arrow(head, family)
                if i >= 0:
                    frame.arrows.append(head[i].start)
            frame.head.append(t)
        last = t
    for frame in reversed(stack):
        if last:
            finish(frame, last.end)
    return sorted(found, key=lambda x: (x[0], -x[1]))


def _arrow(head: list[Token], family: str) -> int:
    """Place where the parameters of an arrow function begin in a head that ends before the arrow; -1 for other arrows."""
    if family == "php":
        i = _at(head, "fn")
        return -1 if i < 0 else i - 1 if i and head[i - 1].text == "static" else i
    if not head:
        return -1
    i = len(head) - 1
    groups = [k for k, t in enumerate(head) if t.text == "()" and (not k or head[k - 1].text in ("=", ",", "=>", "return", "async", ":", ">", "(", "?", "||", "&&", "default", "??"))]
    typed = i and head[i - 1].text in (":", "|", ".", "&")
    if groups and (head[i].kind != "w" or typed):  # parameters in brackets, maybe with a type after
        i = groups[-1]
    elif head[i].kind != "w":
        return -1
    return i - 1 if i and head[i - 1].text == "async" else i


def imports(source: str, language: str, toks: list[Token] | None = None) -> list[str]:
    """What a source imports, as it names it, in order: module strings, or dotted and double-coloned names."""
    family, toks = FAMILY[language], tokens(source, language) if toks is None else toks
    out: list[str] = []
    deep = 0
    for i, t in enumerate(toks):
        deep += (t.text == "{") - (t.text == "}") if t.kind == "p" else 0
        before = toks[i - 1] if i else None
        starts = before is None or before.text in (";", "}", "?>", "pub", ")", "]") or before.line < t.line
        if t.kind != "w" or not starts or (deep > 0 and family in ("php", "js")):
            continue
        rest = toks[i + 1 : i + 400]
        if family == "js" and t.text == "import" and rest and rest[0].text not in ("(", "."):
            for n in rest:
                if n.kind == "s":
                    out.append(n.text.strip("'\"`"))
                    break
                if n.text in (";", "=", "("):
                    break
        elif family == "go" and t.text == "import":
            block = rest[:1] and rest[0].text == "("
            for n in rest:
                if n.kind == "s":
                    out.append(n.text.strip('"`'))
                if n.text == ")" or (not block and (n.kind == "s" or n.line > t.line)):
                    break
        elif family == "java" and t.text == "import" and deep == 0 or family == "rust" and t.text == "use" or family == "php" and t.text == "use":
            name = ""
            for n in rest:
                if n.text in (";", "{", "(", ",") or (n.text == "as" and name):
                    break
                if n.text not in ("static", "function", "const") or name:
                    name += n.text
            if name and not (family == "php" and rest[0].text == "("):
                out.append(name)
        elif family == "rust" and t.text == "extern" and len(rest) > 1 and rest[0].text == "crate":
            out.append(rest[1].text)
    return out
