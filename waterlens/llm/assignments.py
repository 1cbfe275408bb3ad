"""Assignments of source code and configuration files as name-literal pairs, constants propagated.

Heads are names before `=`, `:=`, `+=`, `?=`, `=>` or `:` (quoted and indexed names, flags and type annotations among
them), XML elements, and `name`/`key` with a `value` beside it. Right sides are quoted, triple-quoted and bare literals,
names bound before, references to them (`$a`, `${a}`, `{a}`), sums and adjacent literals of these, in brackets or after
an operator over several lines with comments between, and the lines of a YAML block. A bare value of a line of its own, as in
environment, ini and YAML files, reaches to the next blank if only a comment follows. Literals in a list, tuple or mapping
are values of its name and can be referred to (`a[0]`, `a["k"]`). A quoted name and a literal as the first two arguments
of a call are a pair. A call is its literal if that is its only argument and the call is not named as a look-up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

_NAME = r"[A-Za-z_][\w.\-]*+"
_HEAD = re.compile(
    rf"""(?:(?P<q>["'])(?P<qname>{_NAME})(?P=q)\]?|(?<![\w.\-])-{{0,2}}+(?P<name>{_NAME}))[ \t]*+(?::=|\+=|\?=|=>|[:=])(?!=)[ \t]*+"""
    rf"""|\([ \t]*+(?P<c>["'])(?P<cname>{_NAME})(?P=c)[ \t]*+,\s*+"""
    rf"""|<(?P<tag>{_NAME})(?:[ \t][^<>\n]*+)?>""",
    re.ASCII,
)
_ANNOTATION = re.compile(r"""[A-Za-z_][\w.\[\]|?<>,]*+[ \t]*+=(?!=)[ \t]*+(?=[bBfFrRuU]{0,2}["'`(])""", re.ASCII)
_LITERAL = re.compile(
    r"""(?P<prefix>[bBfFrRuU]{0,2}+)(?:(?P<t>\"\"\"|''')(?P<triple>(?:(?!(?P=t))[^\\]|\\.)*+)(?P=t)|(?P<q>["'`])(?P<text>(?:(?!(?P=q))[^\\\n]|\\.)*+)(?P=q))"""
    r"""|(?P<bare>[A-Za-z0-9+/_.=$\-]++)(?P<call>[(\[])?""",
    re.ASCII | re.DOTALL,
)
#: A whole line's head before its name, and a bare value that fills the rest of a line but for a comment.
_LEAD = re.compile(r"[ \t]*+(?:(?:export|set|ENV|ARG|-)[ \t]++)?+")
_REST = re.compile(r"""(?![bBfFrRuU]{1,2}["'`])(?P<value>[^\s"'`,;](?:[^\s,;]|[,;](?=[^\s]))*+)[,;]?+[ \t]*+(?:(?<=[ \t])(?:\#|;|//)[^\n]*+)?+(?=\n|\Z)""")
_CALL = re.compile(r"[A-Za-z_][\w.:]*+[(\[]|[\[{(]")
_INDEX = re.compile(r"""([A-Za-z_][\w.]*+)\[(?:(\d++)|["']([\w.\-]++)["'])\]""", re.ASCII)
_ITEM = re.compile(
    r"""(?:(?P<k>["']?+)(?P<key>[A-Za-z0-9_.\-]++)(?P=k)[ \t]*+(?::|=>)[ \t]*+)?+"""
    r"""(?:[bBfFrRuU]{0,2}+(?P<q>["'`])(?P<text>(?:(?!(?P=q))[^\\\n]|\\.)*+)(?P=q)|[^\s,\[\](){}"'`]++)""",
    re.ASCII | re.DOTALL,
)
_WRAPPER = re.compile(r"""(?:new[ \t]++)?+(?P<call>[A-Za-z_][\w.:]*+)!?+\(\s*+(?=[bBfFrRuU]{0,2}+["'`])""", re.ASCII)
#: Words of calls whose argument names something to look up.
_LOOKUPS = {"get", "getenv", "env", "environ", "read", "load", "fetch", "find", "lookup", "open", "input", "prompt", "config", "require", "import", "query", "param", "property", "setting", "vault", "t", "gettext", "getpass", "format", "print", "log", "len"}
_CALL_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ELEMENT = re.compile(r"[^<>\n]++(?=</)")
_BLOCK = re.compile(r"[|>][+\-0-9]{0,2}+[ \t]*+\n")
_LINE = re.compile(r"(?P<blanks>[ \t]*+)(?P<line>[^\n]*+)(?:\n|\Z)")
_BLANKS = re.compile(r"(?:[ \t]|\\\n)*+")
_BETWEEN = re.compile(r"(?:\s|\\\n|//[^\n]*+|#[^\n]*+|/\*[^*\n]*+(?:\*(?!/)[^*\n]*+)*+\*/)*+")
_PLUS = re.compile(r"\+(?![+=])")
_REFERENCE = re.compile(r"\$?\{(\w+)\}|\$(\w+)", re.ASCII)
_CHAIN = re.compile(r"[A-Za-z_]+(?:\.[A-Za-z_]+)+", re.ASCII)
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\[.*\]|\$\{.*\}|\{\{.*\}\}|%.*%|your[-_ ].*|change[-_]?me.*|example.*|none|null|true|false|todo)$")
_NAMING = {"name", "key", "id"}
_OPEN = ("[", "{", "(")
#: What the bare literals of code are made of.
_SIMPLE = re.compile(r"[A-Za-z0-9+/_.=$\-]++", re.ASCII)
_APART = re.compile(r"[\s,]*+")


class Literal(NamedTuple):
    """A literal without its quotes, and where it stands."""

    start: int
    end: int
    value: str


class Value:
    """A sum of literals and values: its parts, how often it holds each character, and whether all of it is placeholders."""

    __slots__ = ("counts", "parts", "placeholder")

    def __init__(self, *parts: Literal | Value):
        self.parts = parts
        self.counts: Counter[str] = Counter()
        for part in parts:
            self.counts.update(part.counts if isinstance(part, Value) else part.value)
        self.placeholder = all(p.placeholder if isinstance(p, Value) else _PLACEHOLDER.match(p.value) is not None for p in parts)


def literals(value: Value, seen: set[int]) -> list[Literal]:
    """The literals of a value but for those of values whose ids are in `seen`, which its own join."""
    found = []
    stack: list[Literal | Value] = [value]
    while stack:
        part = stack.pop()
        if isinstance(part, Literal):
            found.append(part)
        elif id(part) not in seen:
            seen.add(id(part))
            stack.extend(part.parts)
    return found


def _lines(text: str, start: int, end: int) -> list[Literal]:
    """The lines of a literal, blanks around them left out."""
    out = []
    while start < end:
        stop = text.find("\n", start, end)
        stop = end if stop < 0 else stop
        line = text[start:stop]
        if line.strip():
            left = start + len(line) - len(line.lstrip())
            out.append(Literal(left, left + len(line.strip()), line.strip()))
        start = stop + 1
    return out


def _block(text: str, head: int, at: int, stop: int) -> list[Literal]:
    """The lines from `at` on that stand deeper than the line of `head`."""
    own = text.rfind("\n", 0, head) + 1
    depth = _LINE.match(text, own).end("blanks") - own
    out = []
    while at < stop:
        line = _LINE.match(text, at, stop)
        if line["line"].strip() and len(line["blanks"]) <= depth:
            break
        if line["line"].strip():
            out.append(Literal(line.start("line"), line.start("line") + len(line["line"].rstrip()), line["line"].rstrip()))
        at = line.end()
    return out


def _items(text: str, at: int, stop: int) -> list[tuple[str, Literal]]:
    """(index or key, literal) of the quoted literals of the collection whose bracket is before `at`."""
    found, place = [], 0
    while True:
        at = _BETWEEN.match(text, at, stop).end()
        item = _ITEM.match(text, at, stop)
        if item is None:
            return found
        if item["text"] is not None:
            found.append((item["key"] or str(place), Literal(*item.span("text"), item["text"])))
        place += 1
        at = _BETWEEN.match(text, item.end(), stop).end()
        if not text.startswith(",", at, stop):
            return found
        at += 1


def _wrapped(text: str, at: int, stop: int) -> tuple[Literal, int] | None:
    """The literal that is the only argument of a call at `at`, and the call's end."""
    call = _WRAPPER.match(text, at, stop)
    if call is None or any(w.lower() in _LOOKUPS for w in _CALL_WORDS.findall(call["call"])):
        return None
    found = _LITERAL.match(text, call.end(), stop)
    if found is None or found["text"] is None:
        return None
    end = _BETWEEN.match(text, found.end(), stop).end()
    return (Literal(*found.span("text"), found["text"]), end + 1) if text.startswith(")", end, stop) else None


def _part(text: str, at: int, stop: int, bound: dict[str, Value], first: bool) -> tuple[Literal | Value | None, list[Literal], int] | None:
    """(literal or value, or lines of a multi-line literal, and their end) at `at`; None where there is none. A bare name that
    is not bound, or a chain of attributes, ends like a part but gives none. Bare parts only stand first."""
    if wrapped := _wrapped(text, at, stop):
        return wrapped[0], [], wrapped[1]
    index = _INDEX.match(text, at, stop)
    if index and (item := bound.get(f"{index[1]}[{index[2] or index[3]}]")) is not None:
        return item, [], index.end()
    found = _LITERAL.match(text, at, stop)
    if found is None or found["call"] or (not first and found["bare"] is not None):
        return None
    end = found.end()
    if found["triple"] is not None:
        lines = _lines(text, *found.span("triple"))
        return (lines[0], [], end) if len(lines) == 1 else (None, lines, end)
    if found["bare"] is not None:
        name = found["bare"].removeprefix("$")
        return bound[name] if name in bound else None if _CHAIN.fullmatch(name) else Literal(*found.span("bare"), found["bare"]), [], end
    refers = _REFERENCE.fullmatch(found["text"])
    name = refers and (refers[1] or refers[2])
    return bound[name] if name in bound else Literal(*found.span("text"), found["text"].replace("\\\n", "")), [], end


def _right(text: str, at: int, stop: int, bound: dict[str, Value]) -> tuple[list[Literal | Value], list[Literal], int]:
    """(parts of the sum, lines of a multi-line literal, where lexing stopped) of a right side."""
    parts: list[Literal | Value] = []
    depth = 0
    after = False  # an operator stands before
    end = at
    while True:
        end = (_BETWEEN if depth or after else _BLANKS).match(text, end, stop).end()
        if text.startswith("(", end, stop) and (not parts or after):
            depth, end = depth + 1, end + 1
            continue
        found = _part(text, end, stop, bound, not parts or after)
        if found is None:
            return parts, [], end
        part, lines, end = found
        if lines:
            return parts, lines, end
        if part is not None:
            parts.append(part)
        ahead = (_BETWEEN if depth else _BLANKS).match(text, end, stop).end()
        plus = _PLUS.match(text, ahead, stop)
        after = plus is not None
        if plus is not None:
            end = plus.end()
        elif ahead == stop or text[ahead] not in "'\"`":  # no adjacent literal
            return parts, [], end


def pairs(text: str) -> Iterator[tuple[str, Value]]:
    """(name, value) of every assignment of literals; each line of a block or of a literal of several lines is a pair of
    its own. Quoted literals are searched for assignments as well. The time is about linear in the text: only blocks
    inside blocks are read once for each level."""
    return _pairs(text, 0, len(text), {})


def _pairs(text: str, at: int, stop: int, bound: dict[str, Value]) -> Iterator[tuple[str, Value]]:
    naming: tuple[int, str] | None = None
    line, seen = text.rfind("\n", 0, at) + 1 if at == 0 or text[at - 1] == "\n" else -1, at  # where the line begins; -1 inside a literal
    while (head := _HEAD.search(text, at, stop)) is not None:
        name = head["qname"] or head["name"] or head["cname"] or head["tag"]
        at = head.end()
        if (feed := text.rfind("\n", seen, head.start())) >= 0:
            line = feed + 1
        seen = head.start()
        if head["tag"]:
            element = _ELEMENT.match(text, at, stop)
            if element:
                yield name, Value(Literal(*element.span(), element[0]))
            at = head.end("tag")  # its attributes are assignments
            continue
        if block := _BLOCK.match(text, at, stop):
            for literal in _block(text, head.start(), block.end(), stop):
                yield name, Value(literal)
            continue
        if annotation := _ANNOTATION.match(text, at, stop):
            at = annotation.end()
        if text[at : at + 1] in _OPEN and at < stop and (items := _items(text, at + 1, stop)):
            for key, item in items:
                bound[f"{name}[{key}]"] = value = Value(item)
                yield name, value
            if len(items) > 1 or text[at] != "(":
                at += 1  # its items may be assignments
                continue
        rest = _REST.match(text, at, stop) if line >= 0 and head["name"] and _LEAD.match(text, line, stop).end() == head.start("name") else None
        if rest and rest["value"].removeprefix("$") not in bound and not _CALL.match(rest["value"]) and not _SIMPLE.fullmatch(rest["value"]):
            bound[name] = value = Value(Literal(*rest.span("value"), rest["value"]))
            yield name, value
            at = rest.end("value")
            continue
        parts, lines, at = _right(text, at, stop, bound)
        for literal in lines:
            yield name, Value(literal)
        if parts:
            only = parts[0] if len(parts) == 1 else None
            value = only if isinstance(only, Value) else Value(*parts)
            if naming and name == "value" and _APART.fullmatch(text, naming[0], head.start()):
                name = naming[1]
            bound[name] = value
            yield name, value
            naming = (at, only.value) if isinstance(only, Literal) and name in _NAMING else None
        for part in (*parts, *lines):
            if isinstance(part, Literal) and text[part.start - 1] in "'\"`":
                yield from _pairs(text, part.start, part.end, bound)
