"""Facts of Rust sources, read from their tokens.

No parser of the language is at hand, so this is a text tier: a lexer, the
nesting of brackets, and the keywords that open items and control flow. One
pass over a file (``mapInArrow``) gives rows of all kinds, tagged; ``table``
picks one kind, and everything after that is DataFrame work.

What the tier does not see: the inside of macro calls (as a parser would not),
types of expressions, and paths in patterns that take arguments. Lines count
from 1 and columns from 0, in characters, as facts have them. A file whose
brackets do not match gives one row of kind ``error`` and nothing else.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.ship import ship

# ---------------------------------------------------------------- tokens

_LEXER = re.compile(
    r"""(?P<blank>\s+|//[^\n]*)
    |(?P<block>/\*)
    |(?P<str>[bc]?r(?P<hash>\#*)"[\s\S]*?"(?P=hash)|[bc]?"(?:\\[\s\S]|[^"\\])*")
    |(?P<char>b?'(?:\\(?:u\{[^}]*\}|x[0-9a-fA-F]{2}|.)|[^'\\\n])')
    |(?P<life>'[A-Za-z_]\w*)
    |(?P<name>(?:r\#)?[A-Za-z_]\w*)
    |(?P<num>\d[\d_]*(?:\.\d[\d_]*)?\w*)
    |(?P<sign>::|->|=>|\.\.=|\.\.\.|\.\.|&&|\|\||[-+*/%^&|=!<>]=|[\s\S])""",
    re.X,
)
_COMMENT = re.compile(r"/\*|\*/")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F_]+)\}|x([0-9a-fA-F]{2})|\r?\n\s*|(.))", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


class Unmatched(ValueError):
    """Brackets do not match, so nothing can be said of the file."""


def string_value(text: str) -> str | None:
    """What a string literal stands for; null for byte and C strings."""
    if text[0] in "bc":
        return None
    if text[0] == "r":
        return text[text.index('"') + 1 : text.rindex('"')]
    swap = lambda m: chr(int((m[1] or m[2]).replace("_", ""), 16)) if m[1] or m[2] else "" if m[3] is None else _PLAIN.get(m[3], m[3])
    return _ESCAPE.sub(swap, text[1:-1])


class Tokens:
    """Kinds, texts and places of the tokens of a source, and the partner of each bracket."""

    def __init__(self, source: str):
        self.source, self.kind, self.text, self.start = source, [], [], []
        at = 0
        while at < len(source):
            m = _LEXER.match(source, at)
            at = m.end()
            if m.lastgroup == "block":
                at = self._past_comment(at)
            elif m.lastgroup != "blank":
                self.kind.append("str" if m["str"] is not None else m.lastgroup)
                self.text.append(m[0])
                self.start.append(m.start())
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.partner = self._partners()

    def _past_comment(self, at: int) -> int:
        """Block comments nest; one that does not end takes the rest."""
        depth = 1
        while depth:
            m = _COMMENT.search(self.source, at)
            if not m:
                return len(self.source)
            depth += 1 if m[0] == "/*" else -1
            at = m.end()
        return at

    def _partners(self) -> dict[int, int]:
        out, held = {}, []
        for i, (k, t) in enumerate(zip(self.kind, self.text, strict=True)):
            if k != "sign":
                continue
            if t in _OPEN:
                held.append(i)
            elif t in _CLOSE:
                if not held or _OPEN[self.text[held[-1]]] != t:
                    raise Unmatched(f"unmatched {t} in line {self.place(i)[0]}")
                out[held.pop()] = i
        if held:
            raise Unmatched(f"unmatched {self.text[held[-1]]} in line {self.place(held[-1])[0]}")
        return out

    def __len__(self):
        return len(self.text)

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def place(self, i: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.lines, self.start[i])
        return line, self.start[i] - self.lines[line - 1]

    def tight(self, begin: int, end: int) -> str:
        """The tokens without any space between them, as patterns are matched against."""
        return "".join(self.text[begin:end]).replace(" ", "")

    def spaced(self, begin: int, end: int) -> str:
        """The tokens with a space between any two."""
        return " ".join(self.text[begin:end])

    def seek(self, begin: int, end: int, *signs: str, angles: bool = False) -> int:
        """The first of the signs outside brackets (and angle brackets), else ``end``."""
        i, depth = begin, 0
        while i < end:
            t = self.text[i]
            if depth == 0 and t in signs and self.kind[i] in ("sign", "name"):
                return i
            if self.kind[i] == "sign":
                if t in _OPEN:
                    i = self.partner[i]
                elif angles and t == "<":
                    depth += 1
                elif angles and t == ">" and depth:
                    depth -= 1
            i += 1
        return end

    def split(self, begin: int, end: int, sign: str = ",") -> list[tuple[int, int]]:
        """The parts between signs outside all brackets; empty ones are left out."""
        out = []
        while begin < end:
            stop = self.seek(begin, end, sign, angles=True)
            if stop > begin:
                out.append((begin, stop))
            begin = stop + 1
        return out

    def past_angles(self, i: int, end: int) -> int:
        """Past the ``<...>`` that opens at i."""
        depth = 0
        while i < end:
            t = self.text[i]
            if self.kind[i] == "sign":
                depth += (t == "<") - (t == ">")
                if t in _OPEN:
                    i = self.partner[i]
            i += 1
            if depth <= 0:
                return i
        return end


# ---------------------------------------------------------------- types


def _bare(t: Tokens, begin: int, end: int) -> int:
    """Past references, lifetimes and ``mut`` ahead of a type."""
    while begin < end and (t.text[begin] in ("&", "&&", "mut") or t.kind[begin] == "life"):
        begin += 1
    return begin


def _path(t: Tokens, begin: int, end: int) -> tuple[list[int], list[tuple[int, int]], list[tuple[int, int]]] | None:
    """Of a path type: places of its segments, generic arguments of the last one, and those of all. Null for other types."""
    if begin < end and t.text[begin] == "::":
        begin += 1
    segments, last, every = [], [], []
    while begin < end and t.kind[begin] == "name" and t.text[begin] not in ("dyn", "impl", "fn", "for", "unsafe", "extern"):
        segments.append(begin)
        begin, last = begin + 1, []
        if t.at(begin) == "::" and t.at(begin + 1) == "<":
            begin += 1
        if begin < end and t.text[begin] == "<":
            close = t.past_angles(begin, end)
            last = [(a, b) for a, b in t.split(begin + 1, close - 1) if t.kind[a] != "life" and t.seek(a, b, "=", angles=True) == b]
            every += last
            begin = close
        if begin < end and t.text[begin] == "::":
            begin += 1
            continue
        break
    return (segments, last, every) if segments else None


def type_names(t: Tokens, begin: int, end: int) -> list[str]:
    """All names that a type mentions by path: segments, then those of generic arguments."""
    begin = _bare(t, begin, end)
    if begin >= end:
        return []
    if t.text[begin] == "(":
        return [n for a, b in t.split(begin + 1, t.partner[begin]) for n in type_names(t, a, b)]
    if t.text[begin] == "[":
        return type_names(t, begin + 1, t.seek(begin + 1, t.partner[begin], ";"))
    found = _path(t, begin, end)
    if not found:
        return []
    return [t.text[i] for i in found[0]] + [n for a, b in found[2] for n in type_names(t, a, b)]


def type_flags(t: Tokens, begin: int, end: int) -> dict[str, bool]:
    """Whether a type is dynamic, a vector of boxed dynamic ones, or a map or set with the default hasher."""
    no = {"involves_dyn": False, "is_vec_box_dyn": False, "is_default_hasher": False}
    if t.at(begin) == "dyn":
        return no | {"involves_dyn": True}
    if t.at(begin) in ("&", "&&"):
        return no | {"involves_dyn": t.at(_bare(t, begin, end)) == "dyn"}
    found = _path(t, begin, end)
    if not found:
        return no
    name, args = t.text[found[0][-1]], found[1]
    boxed = lambda a, b: (p := _path(t, a, b)) and t.text[p[0][-1]] == "Box" and p[1] and t.text[p[1][0][0]] == "dyn"
    return {
        "involves_dyn": name in ("Box", "Arc", "Rc") and bool(args) and t.text[args[0][0]] == "dyn",
        "is_vec_box_dyn": name == "Vec" and bool(args) and bool(boxed(*args[0])),
        "is_default_hasher": (name == "HashMap" and len(args) == 2) or (name == "HashSet" and len(args) == 1),
    }


# ---------------------------------------------------------------- the walk


@dataclass(frozen=True)
class Scope:
    """Where the walk is: what a row takes from its surroundings."""

    fn: int | None = None
    depth: int = 0
    loops: int = 0
    branch: str | None = None
    items: int = 0
    features: tuple[str, ...] = ()
    predicates: tuple[str, ...] = ()
    owner: str | None = None
    inherent: str | None = None
    literals: bool = True  # whether a path before a brace is a struct literal


_MODIFIERS = {"pub", "const", "async", "unsafe", "extern", "default", "move"}
_NOT_OPERANDS = {"return", "in", "if", "while", "match", "let", "mut", "ref", "as", "else", "break", "move", "yield"}
_TYPE_KINDS = {"struct", "enum", "union", "trait"}


class Reader:
    def __init__(self, source: str):
        self.t = Tokens(source)
        self.rows: list[tuple[str, int | None, int, int, dict]] = []
        self.functions: list[dict] = []
        self.counted: list[set[str]] = []  # names of reference-counted bindings, by function
        self.strings: list[set[str]] = []

    def read(self) -> list[tuple[str, int | None, int, int, dict]]:
        self.walk(0, len(self.t), Scope())
        return self.rows

    def emit(self, tag: str, i: int, c: Scope | int | None, **body) -> dict:
        fn = c.fn if isinstance(c, Scope) else c
        self.rows.append((tag, fn, *self.t.place(i), body))
        return body

    # -- attributes

    def attribute(self, i: int, c: Scope) -> tuple[int, tuple[int, int] | None]:
        """Past the attribute at i, and the range of its text if it is an outer one."""
        t = self.t
        inner = t.at(i + 1) == "!"
        opening = i + 1 + inner
        if t.at(opening) != "[":
            return i + 1, None
        begin, close = opening + 1, t.partner[opening]
        name = begin
        while t.at(name + 1) == "::":
            name += 2
        self.emit("attribute", i, c, name=t.at(name), text=t.tight(begin, close))
        return close + 1, None if inner else (begin, close)

    def gated(self, c: Scope, attributes: list[tuple[int, int]]) -> Scope:
        """The scope with the conditions that ``cfg`` and ``cfg_attr`` attributes add."""
        t, features, predicates = self.t, [], []
        for begin, close in attributes:
            if t.at(begin + 1) != "(":
                continue
            a, b = begin + 2, t.partner[begin + 1]
            if t.at(begin) == "cfg":
                predicates.append(t.spaced(a, b))
                if b - a == 3 and t.at(a) == "feature" and t.at(a + 1) == "=":
                    features.append(string_value(t.text[a + 2]) or "")
            elif t.at(begin) == "cfg_attr":
                parts = t.split(a, b)
                predicates += [f"all({t.spaced(*parts[0])}, {t.spaced(x + 2, t.partner[x + 1])})" for x, _ in parts[1:] if t.at(x) == "cfg" and t.at(x + 1) == "("]
        if not predicates:
            return c
        return replace(c, features=(*c.features, *features), predicates=tuple(sorted({*c.predicates, *predicates})))

    def visibility(self, i: int) -> tuple[str, int]:
        """The visibility stated ahead of the keyword at i, and where the item's modifiers begin."""
        t, k = self.t, i - 1
        while k >= 0 and (t.text[k] in _MODIFIERS - {"pub"} or (t.kind[k] == "str" and t.at(k - 1) == "extern")):
            k -= 1
        if t.at(k) == "pub":
            return "public", k
        if t.at(k) == ")" and (opening := next((o for o, p in t.partner.items() if p == k), None)) and t.at(opening - 1) == "pub":
            text = t.tight(opening + 1, k)
            return {"crate": "crate", "super": "super"}.get(text, text.removeprefix("in")), opening - 1
        return "private", k + 1

    # -- the general walk

    def walk(self, i: int, end: int, c: Scope) -> None:
        t, attributes = self.t, []
        while i < end:
            k, text = t.kind[i], t.text[i]
            if text == "#" and k == "sign":
                i, held = self.attribute(i, c)
                attributes += [held] if held else []
                continue
            if text == "pub" and k == "name":  # a visibility leaves the attributes ahead of it to the item
                i = t.partner[i + 1] + 1 if t.at(i + 1) == "(" else i + 1
                continue
            if k == "name" and (step := getattr(self, f"on_{text}", None)):
                if (after := step(i, end, c, attributes)) is not None:
                    i, attributes = after, []
                    continue
            if text not in _MODIFIERS and not (k == "str" and t.at(i - 1) == "extern"):
                attributes = [] if k != "sign" or text not in "()" else attributes
            i = self.expression(i, end, c)

    def expression(self, i: int, end: int, c: Scope) -> int:
        """One token of an expression, or one path, call, macro or closure head."""
        t, k, text = self.t, self.t.kind[i], self.t.text[i]
        if k == "str":
            if (value := string_value(text)) is not None:
                self.emit("string_literal", i, c, value=value)
        elif k == "name" and t.at(i - 1) != ".":
            return self.path(i, end, c)
        elif k == "name" and (t.at(i + 1) == "(" or (t.at(i + 1) == "::" and t.at(i + 2) == "<")):
            simple = t.kind[i - 2] == "name" and t.at(i - 3) not in (".", "::")
            self.rows.append(("method_call", c.fn, *t.place(i - 1), {"name": text, "text": f".{text}()", "receiver": t.text[i - 2] if simple else None, "loop_depth": c.loops}))
            if t.at(i + 1) != "::":
                return i + 1
            close = t.past_angles(i + 2, end)
            for a, b in t.split(i + 3, close - 1):
                self.type_refs(a, b, "body", c.fn)
            return close
        elif text in ("|", "||") and k == "sign" and self.opens_closure(i):
            self.emit("control_flow", i, c, kind="closure", depth=c.depth, loop_depth=c.loops, parent_branch=c.branch)
            return i + 1 if text == "||" else t.seek(i + 1, end, "|") + 1
        elif text in ("+", "-", "*", "/") and k == "sign" and c.fn is not None and i and (t.kind[i - 1] in ("num", "str", "char") or t.text[i - 1] in (")", "]") or (t.kind[i - 1] == "name" and t.text[i - 1] not in _NOT_OPERANDS)):
            self.functions[c.fn]["has_arithmetic"] = True
        return i + 1

    def opens_closure(self, i: int) -> bool:
        before = self.t.at(i - 1)
        return i == 0 or before in ("(", ",", "=", "=>", "{", "}", ";", "[", "&&", "move", "return", "else", ":", "&", "in") or (self.t.text[i] == "|" and before == "||")

    def path(self, i: int, end: int, c: Scope) -> int:
        t, segments, j = self.t, [self.t.text[i]], i + 1
        while t.at(j) == "::" and j < end:
            if t.at(j + 1) == "<":
                close = t.past_angles(j + 1, end)
                for a, b in t.split(j + 2, close - 1):
                    self.type_refs(a, b, "body", c.fn)
                j = close
            elif j + 1 < end and t.kind[j + 1] == "name":
                segments.append(t.text[j + 1])
                j += 2
            else:
                break
        text, after = "::".join(segments), t.at(j)
        if after == "!" and t.at(j + 1) in _OPEN or (after == "!" and segments == ["macro_rules"]):
            self.emit("macro", i, c, text=f"{text}!")
            opening = j + 1 if segments != ["macro_rules"] else j + 2
            return t.partner.get(opening, opening) + 1
        called = after == "("
        if len(segments) > 1 and not (after == "{" and c.literals):
            self.emit("reference", i, c, kind="call" if called else "type", origin="expression_path", text=text, alias=None, glob=False)
        elif len(segments) == 1 and called and text not in _NOT_OPERANDS:
            self.emit("reference", i, c, kind="call", origin="call_path", text=text, alias=None, glob=False)
        return j

    # -- types

    def type_refs(self, begin: int, end: int, context: str, fn: int | None, nested: bool = True) -> None:
        """One row for a type; in bodies also for the types inside it."""
        t = self.t
        if begin >= end:
            return
        at = begin + (t.text[begin] in ("::", "dyn") and begin + 1 < end)
        self.emit("type_ref", at, fn, text=t.tight(begin, end), context=context, **type_flags(t, begin, end))
        if not nested or context != "body":
            return
        inner = _bare(t, begin, end)
        if inner > begin:
            self.type_refs(inner, end, context, fn)
        elif t.text[begin] == "(":
            for a, b in t.split(begin + 1, t.partner[begin]):
                self.type_refs(a, b, context, fn)
        elif t.text[begin] == "[":
            self.type_refs(begin + 1, t.seek(begin + 1, t.partner[begin], ";"), context, fn)
        elif found := _path(t, begin, end):
            for a, b in found[2]:
                self.type_refs(a, b, context, fn)

    def on_as(self, i, end, c, attributes):
        t = self.t
        begin = i + 1
        j = _bare(t, begin, end)
        if t.at(j) in ("(", "["):
            j = t.partner[j] + 1
        else:
            while j < end and t.text[j] in ("*", "const", "mut", "dyn"):
                j += 1
            while j < end and t.kind[j] == "name":
                j += 1
                if t.at(j) == "<":
                    j = t.past_angles(j, end)
                if t.at(j) != "::":
                    break
                j += 1
        self.type_refs(begin, j, "body", c.fn)
        return j

    # -- items

    def on_use(self, i, end, c, attributes):
        t, stop = self.t, self.t.seek(i, end, ";")
        gates = self.gated(c, attributes)
        pending = [(i + 1, stop, ())]
        while pending:
            a, b, prefix = pending.pop()
            names = []
            while a < b and (t.kind[a] == "name" or t.text[a] == "::") and t.text[a] != "as":
                names += [t.text[a]] if t.kind[a] == "name" else []
                a += 1
            whole = (*prefix, *names)
            if a < b and t.text[a] == "{":
                pending += [(x, y, whole) for x, y in reversed(t.split(a + 1, t.partner[a]))]
                continue
            alias = t.at(a + 1) if t.at(a) == "as" else None
            self.emit("reference", i, c, kind="import", origin="import", text="::".join(whole), alias=alias, glob=a < b and t.text[a] == "*", predicates=list(gates.predicates))
        return stop + 1

    def on_mod(self, i, end, c, attributes):
        t = self.t
        if i + 1 >= end or t.kind[i + 1] != "name":
            return None
        tested = any(t.tight(a, b) == "cfg(test)" for a, b in attributes)
        gates = self.gated(c, attributes)
        self.emit("module", i, c, name=t.text[i + 1], is_cfg_test=tested, inline=t.at(i + 2) == "{", predicates=list(gates.predicates))
        self.define("module", i + 1, gates)
        if t.at(i + 2) != "{":
            return i + 3
        self.walk(i + 3, t.partner[i + 2], gates)
        return t.partner[i + 2] + 1

    def define(self, kind: str, name: int, c: Scope, owner: str | None = None) -> None:
        self.emit("definition", name, c, kind=kind, name=self.t.text[name], owner=owner, predicates=list(c.predicates))

    def signature(self, i: int, end: int) -> dict:
        """Of the function whose name is at i: ranges of parameters and return type, and where the body opens (or the end sign)."""
        t, j = self.t, i + 1
        if t.at(j) == "<":
            j = t.past_angles(j, end)
        if t.at(j) != "(":
            return {}
        parameters = []
        for a, b in t.split(j + 1, t.partner[j]):
            while t.text[a] == "#" and t.at(a + 1) == "[":
                a = t.partner[a + 1] + 1
            colon = t.seek(a, b, ":", angles=True)
            if colon < b and t.at(_bare(t, a, colon)) != "self":
                parameters.append((a, colon, b))
        body = t.seek(t.partner[j] + 1, end, "{", ";")
        returned = None
        if t.at(t.partner[j] + 1) == "->":
            returned = (t.partner[j] + 2, t.seek(t.partner[j] + 2, body, "where", angles=True))
        return {"parameters": parameters, "returned": returned, "body": body}

    def on_fn(self, i, end, c, attributes):
        t = self.t
        if i + 1 >= end or t.kind[i + 1] != "name" or not (s := self.signature(i + 1, end)):
            return None
        visibility, first = self.visibility(i)
        unsafe = next((k for k in range(first, i) if t.text[k] == "unsafe"), None)
        gates = self.gated(c, attributes)
        index, braced = len(self.functions), t.at(s["body"]) == "{"
        if unsafe is not None and (braced or c.owner is None):
            self.emit("unsafe_site", unsafe, index, kind="fn", text="unsafe fn")
        name_of = lambda a, b: next((t.text[k] for k in range(a, b) if t.kind[k] == "name" and t.text[k] not in ("mut", "ref")), None)
        names = [n for _, a, b in s["parameters"] for n in type_names(t, a + 1, b)] + (type_names(t, *s["returned"]) if s["returned"] else [])
        body = {
            "name": t.text[i + 1], "is_unsafe": unsafe is not None, "params": [{"name": n, "type": t.tight(m + 1, b)} for a, m, b in s["parameters"] if (n := name_of(a, m))],
            "return_type": t.tight(*s["returned"]) if s["returned"] else None, "type_names": names, "item_depth": c.items, "has_arithmetic": False,
            "body_lines": t.place(t.partner[s["body"]])[0] - t.place(s["body"])[0] + 1 if braced else 0, "is_associated": c.owner is not None, "method_of": c.inherent if braced else None,
            "is_forwarder": braced and c.inherent is not None and self.forwards(s["body"] + 1, t.partner[s["body"]]), "visibility": visibility, "features": list(gates.features), "predicates": list(gates.predicates),
        }
        self.functions.append(body)
        self.counted.append(set())
        self.strings.append(set())
        self.rows.append(("function", index, *t.place(i + 1), body))
        self.define("method" if c.owner else "function", i + 1, gates, c.owner)
        if s["returned"]:
            self.type_refs(*s["returned"], "return", index)
        for a, colon, b in s["parameters"]:
            self.type_refs(colon + 1, b, "param", index)
            for k in self.pattern_names(a, colon):
                self.bind(k, c, index, self.is_counted(colon + 1, b))
                self.strings[index] |= {t.text[k]} if t.tight(colon + 1, b) in ("String", "&mutString") else set()
        if not braced:
            return s["body"] + 1
        free = c.owner is None
        inner = replace(gates, fn=index, owner=None, inherent=None, items=c.items + free, literals=True)
        self.walk(s["body"] + 1, t.partner[s["body"]], inner)
        return t.partner[s["body"]] + 1

    def forwards(self, begin: int, end: int) -> bool:
        """Whether a body is one call ``self.field.method(...)``, with ``?`` or ``.await`` after it at most."""
        t = self.t
        end -= end > begin and t.text[end - 1] == ";"
        if t.text[begin : begin + 2] != ["self", "."] or t.at(begin + 3) != "." or begin + 5 >= end or t.kind[begin + 4] != "name":
            return False
        j = begin + 5
        if t.at(j) == "::" and t.at(j + 1) == "<":
            j = t.past_angles(j + 1, end)
        if t.at(j) != "(":
            return False
        rest = t.text[t.partner[j] + 1 : end]
        return "".join(rest).replace("?", "").replace(".await", "") == ""

    def type_item(self, kind, i, end, c, attributes):
        t = self.t
        if i + 1 >= end or t.kind[i + 1] != "name" or t.at(i + 2) not in ("<", "{", "(", ";", "where", ":"):
            return None
        name, gates, (visibility, _) = t.text[i + 1], self.gated(c, attributes), self.visibility(i)
        j = t.past_angles(i + 2, end) if t.at(i + 2) == "<" else i + 2
        body = t.seek(j, end, "{", ";", "(" if kind == "struct" and t.at(j) == "(" else "{")
        edges: list[str] = []
        row = self.emit("type_def", i + 1, c, name=name, kind=kind, visibility=visibility, features=list(gates.features), predicates=list(gates.predicates), edges=edges)
        self.define(kind, i + 1, gates)
        if t.at(body) not in _OPEN:
            return body + 1
        close = t.partner[body]
        inner = replace(gates, items=c.items + 1)
        if kind == "trait":
            before = len(self.functions)
            self.walk(body + 1, close, replace(inner, owner=name, inherent=None))
            row["edges"] = [n for f in self.functions[before:] if f["is_associated"] for n in f["type_names"]]
        elif kind == "enum":
            for a, b in t.split(body + 1, close):
                a = self.past_attributes(a, inner)
                if t.at(a + 1) in ("{", "("):
                    edges += self.fields(a + 2, t.partner[a + 1], t.at(a + 1) == "{", inner)
                self.walk(t.seek(a, b, "=") + 1, b, inner)
        else:
            edges += self.fields(body + 1, close, t.at(body) == "{", inner)
        return close + 1

    def past_attributes(self, a: int, c: Scope) -> int:
        while self.t.at(a) == "#":
            a, _ = self.attribute(a, c)
        return a

    def fields(self, begin: int, end: int, named: bool, c: Scope) -> list[str]:
        """Type references of fields, and the names that their types mention."""
        t, out = self.t, []
        for a, b in t.split(begin, end):
            a = self.past_attributes(a, c)
            if named:
                a = t.seek(a, b, ":", angles=True) + 1
            elif t.at(a) == "pub":
                a = t.partner[a + 1] + 1 if t.at(a + 1) == "(" and t.at(a + 2) in ("crate", "super", "self", "in") else a + 1
            if a < b:
                self.type_refs(a, b, "field", c.fn)
                out += type_names(t, a, b)
        return out

    def on_struct(self, i, end, c, attributes):
        return self.type_item("struct", i, end, c, attributes)

    def on_enum(self, i, end, c, attributes):
        return self.type_item("enum", i, end, c, attributes)

    def on_trait(self, i, end, c, attributes):
        return self.type_item("trait", i, end, c, attributes)

    def on_union(self, i, end, c, attributes):
        return self.type_item("union", i, end, c, attributes) if self.t.at(i + 2) in ("{", "<") and self.t.at(i - 1) != "." else None

    def on_impl(self, i, end, c, attributes):
        t = self.t
        j = t.past_angles(i + 1, end) if t.at(i + 1) == "<" else i + 1
        body = t.seek(j, end, "{", ";")
        if t.at(body) != "{":
            return None
        if t.at(i - 1) == "unsafe":
            self.emit("unsafe_site", i - 1, c, kind="impl", text="unsafe impl")
        head_end = t.seek(j, body, "where", angles=True)
        cut = t.seek(j, head_end, "for", angles=True)
        trait = None
        begin = j
        if cut < head_end and t.at(cut + 1) != "<":
            found = _path(t, j + (t.at(j) == "!"), cut)
            trait, begin = t.text[found[0][-1]] if found else None, cut + 1
        names = type_names(t, begin, head_end)
        gates, close = self.gated(c, attributes), t.partner[body]
        inner = replace(gates, items=c.items + 1)
        if not names:
            self.walk(body + 1, close, inner)
            return close + 1
        row = self.emit("impl_block", begin, c, type=names[0], trait=trait, predicates=list(gates.predicates), edges=[])
        before = len(self.functions)
        self.walk(body + 1, close, replace(inner, owner=names[0], inherent=None if trait else names[0]))
        row["edges"] = ([trait] if trait else []) + [n for f in self.functions[before:] if f["is_associated"] for n in f["type_names"]]
        return close + 1

    def value_item(self, kind, i, name, end, c, attributes):
        t, gates = self.t, self.gated(c, attributes)
        self.define(kind, name, gates, c.owner)
        stop = t.seek(name, end, ";")
        inner = replace(gates, items=c.items + 1)
        sign = t.seek(name, stop, "=", angles=True)
        if kind == "type_alias":
            if c.owner is None and sign < stop:
                self.emit("type_alias", name, c, name=t.text[name], edges=type_names(t, sign + 1, stop))
            self.type_refs(sign + 1, stop, "body", c.fn)
            return stop + 1
        if t.at(name + 1) == ":":
            self.type_refs(name + 2, sign, "body", c.fn)
        self.walk(sign + 1, stop, inner)
        return stop + 1

    def on_const(self, i, end, c, attributes):
        t = self.t
        return self.value_item("constant", i, i + 1, end, c, attributes) if i + 2 < end and t.kind[i + 1] == "name" and t.at(i + 2) == ":" else None

    def on_static(self, i, end, c, attributes):
        t = self.t
        name = i + 1 + (t.at(i + 1) == "mut")
        return self.value_item("static", i, name, end, c, attributes) if name + 1 < end and t.kind[name] == "name" and t.at(name + 1) == ":" else None

    def on_type(self, i, end, c, attributes):
        t = self.t
        return self.value_item("type_alias", i, i + 1, end, c, attributes) if i + 2 < end and t.kind[i + 1] == "name" and t.at(i + 2) in ("=", "<", ";", ":") else None

    def on_extern(self, i, end, c, attributes):
        t = self.t
        if t.at(i + 1) == "crate":
            return t.seek(i, end, ";") + 1
        j = i + 1 + (i + 1 < end and t.kind[i + 1] == "str")
        if t.at(j) != "{":
            return None
        self.emit("extern_block", i, c, text="extern block")
        return t.partner[j] + 1

    # -- control flow

    def flow(self, kind, i, c, depth, loops, **more):
        self.emit("control_flow", i, c, kind=kind, depth=depth, loop_depth=loops, parent_branch=c.branch, **more)

    def block(self, begin: int, end: int) -> int:
        """Where the block of a control-flow head opens."""
        return self.t.seek(begin, end, "{")

    def on_if(self, i, end, c, attributes):
        t = self.t
        opening = self.block(i + 1, end)
        if opening >= end:
            return None
        close, links = t.partner[opening], 1
        j, has_else = close + 1, t.at(close + 1) == "else" and close + 1 < end
        while t.at(j) == "else" and j < end:  # how long the chain is
            links += 1
            nested = t.at(j + 1) == "if"
            follows = self.block(j + 1, end)
            j = t.partner.get(follows, end) + 1
            if not nested:
                break
        line, col = t.place(close + 1) if has_else else (None, None)
        self.flow("if", i, c, c.depth + 1, c.loops, has_else=has_else, chain_len=None if c.branch == "if" or not has_else else links, else_line=line, else_col=col)
        inner = replace(c, depth=c.depth + 1, branch="if", literals=True)
        self.walk(i + 1, opening, replace(inner, literals=False))
        self.walk(opening + 1, close, inner)
        if not has_else:
            return close + 1
        if t.at(close + 2) == "if":
            return self.on_if(close + 2, end, inner, [])
        self.walk(close + 3, t.partner[close + 2], inner)
        return t.partner[close + 2] + 1

    def on_match(self, i, end, c, attributes):
        t = self.t
        opening = self.block(i + 1, end)
        if opening >= end:
            return None
        self.flow("match", i, c, c.depth + 1, c.loops)
        inner = replace(c, depth=c.depth + 1, branch="match", literals=True)
        self.walk(i + 1, opening, replace(inner, literals=False))
        close, p = t.partner[opening], opening + 1
        while p < close:
            p = self.past_attributes(p, inner)
            arrow = t.seek(p, close, "=>")
            guard = t.seek(p, arrow, "if")
            self.pattern(p, guard, inner)
            self.walk(guard + 1, arrow, inner)
            body = arrow + 1
            stop = t.partner[body] + 1 if t.at(body) == "{" else self.arm_end(body, close)
            self.walk(body, stop, inner)
            p = stop + (t.at(stop) == ",")
        return close + 1

    def arm_end(self, begin: int, end: int) -> int:
        """The comma after an arm's expression; commas of generic arguments after ``::`` do not count."""
        t, i = self.t, begin
        while i < end and t.text[i] != ",":
            if t.text[i] == "::" and t.at(i + 1) == "<":
                i = t.past_angles(i + 1, end)
                continue
            i = t.partner.get(i, i) + 1
        return i

    def pattern(self, begin: int, end: int, c: Scope) -> None:
        """References of the plain paths of a pattern."""
        t, i = self.t, begin
        while i < end:
            if t.kind[i] == "name" and t.at(i + 1) == "::":
                j, segments = i, [t.text[i]]
                while t.at(j + 1) == "::" and j + 2 < end and t.kind[j + 2] == "name":
                    j += 2
                    segments.append(t.text[j])
                if t.at(j + 1) not in ("(", "{"):
                    self.emit("reference", i, c, kind="type", origin="expression_path", text="::".join(segments), alias=None, glob=False)
                i = j
            i += 1

    def loop(self, kind, i, head, opening, c):
        self.flow(kind, i, c, c.depth + 1, c.loops + 1)
        inner = replace(c, depth=c.depth + 1, loops=c.loops + 1, literals=True)
        self.walk(head, opening, replace(inner, literals=False))
        self.walk(opening + 1, self.t.partner[opening], inner)
        return self.t.partner[opening] + 1

    def on_for(self, i, end, c, attributes):
        t = self.t
        opening = self.block(i + 1, end)
        if t.at(i + 1) == "<" or opening >= end:
            return None
        inside = t.seek(i + 1, opening, "in")
        for k in self.pattern_names(i + 1, inside):
            self.bind(k, replace(c, loops=c.loops + 1), c.fn, False, placed=False)
        return self.loop("for", i, inside + 1, opening, c)

    def on_while(self, i, end, c, attributes):
        opening = self.block(i + 1, end)
        return self.loop("while", i, i + 1, opening, c) if opening < end else None

    def on_loop(self, i, end, c, attributes):
        return self.loop("loop", i, i + 1, i + 1, c) if self.t.at(i + 1) == "{" else None

    def on_unsafe(self, i, end, c, attributes):
        if self.t.at(i + 1) == "{":
            self.emit("unsafe_site", i, c, kind="block", text="unsafe block")
            return i + 1
        return None

    # -- bindings

    def pattern_names(self, begin: int, end: int) -> list[int]:
        """Places of the names that a pattern binds."""
        t, out = self.t, []
        for k in range(begin, end):
            if t.kind[k] != "name" or t.text[k] in ("mut", "ref", "box", "true", "false", "_"):
                continue
            if t.at(k + 1) in ("::", "(", "{", "!") or t.at(k - 1) == "::" or (t.at(k + 1) == ":" and k + 1 < end):
                continue  # a path, a constructor, or the name of a field
            if t.text[k][:1].isupper():
                continue
            out.append(k)
        return out

    def is_counted(self, begin: int, end: int) -> bool:
        found = _path(self.t, _bare(self.t, begin, end), end)
        return bool(found) and self.t.text[found[0][-1]] in ("Arc", "Rc")

    def bind(self, k: int, c: Scope, fn: int | None, counted: bool, placed: bool = True) -> None:
        name = self.t.text[k]
        if counted and fn is not None:
            self.counted[fn].add(name)
        if not name.startswith("_"):
            self.emit("binding", k, fn, name=name, loop_depth=c.loops, is_refcounted=counted, is_wildcard=False, has_init=False, init_is_write_macro=False, placed=placed)

    def on_let(self, i, end, c, attributes):
        t = self.t
        if t.at(i - 1) in ("if", "while", "&&", "||", "(") or c.fn is None:
            sign = t.seek(i, end, "=", "{")  # a condition binds nothing that counts
            self.pattern(i + 1, sign, c)
            return sign
        stop = t.seek(i + 1, end, ";", "=")
        colon = t.seek(i + 1, stop, ":", angles=True)
        head = min(colon, stop)
        typed = (colon + 1, stop) if colon < stop else None
        value = stop + 1 if t.at(stop) == "=" else None
        made = value is not None and t.at(value) in ("Arc", "Rc") and t.at(value + 1) == "::"
        if t.text[i + 1 : head] == ["_"]:
            written = value is not None and t.at(value) in ("write", "writeln") and t.at(value + 1) == "!" and t.at(value + 3) in self.strings[c.fn]
            self.emit("binding", i + 1, c, name="_", loop_depth=c.loops, is_refcounted=False, is_wildcard=True, has_init=value is not None, init_is_write_macro=written, placed=True)
        for k in self.pattern_names(i + 1, head):
            self.bind(k, c, c.fn, made or (typed is not None and self.is_counted(*typed)))
            if (typed and t.tight(*typed) == "String") or (value is not None and t.at(value) == "String" and t.at(value + 1) == "::"):
                self.strings[c.fn].add(t.text[k])
        if typed:
            self.type_refs(*typed, "body", c.fn)
        return stop + 1


# ---------------------------------------------------------------- fingerprints

# The 64-bit FNV-1a offset and prime, and the tags of control flow.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
FLOW_TAGS = {"if": 0, "match": 1, "for": 2, "while": 3, "loop": 4, "closure": 5}


def fnv1a(data: bytes, state: int = FNV_OFFSET) -> int:
    """The 64-bit FNV-1a hash, from a state on."""
    for b in data:
        state = (state ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return state


def fingerprints(rows: list[tuple]) -> list[tuple]:
    """Rows of tag fingerprint: skeleton and exact hash, and how many facts each function has.

    The skeleton takes the number of parameters, whether anything is returned,
    the kinds of control flow in order and the numbers of calls, bindings and
    type references; the exact hash also the names of methods and texts of types.
    """
    count = lambda n: n.to_bytes(8, "little")
    by: dict[int, dict[str, list[dict]]] = {}
    for tag, fn, _, _, body in rows:
        if fn is not None and tag in ("control_flow", "method_call", "binding", "type_ref"):
            by.setdefault(fn, {}).setdefault(tag, []).append(body)
    out = []
    for tag, fn, line, col, body in rows:
        if tag != "function":
            continue
        held = by.get(fn, {})
        flows, calls, bound, types = (held.get(k, []) for k in ("control_flow", "method_call", "binding", "type_ref"))
        shape = count(len(body["params"])) + bytes([body["return_type"] is not None]) + bytes(FLOW_TAGS[f["kind"]] for f in flows)
        skeleton = fnv1a(shape + count(len(calls)) + count(len(bound)) + count(len(types)))
        exact = fnv1a(shape + "".join(x["name"] for x in calls).encode() + count(len(bound)) + "".join(x["text"] for x in types).encode())
        out.append(("fingerprint", fn, line, col, {"name": body["name"], "skeleton": f"{skeleton:016x}", "exact": f"{exact:016x}", "fact_count": len(flows) + len(calls) + len(bound) + len(types)}))
    return out


def scan(source: str) -> list[tuple[str, int | None, int, int, dict]]:
    """All rows of one source: tag, function, line, column, body."""
    try:
        reader = Reader(source)
        rows = reader.read()
    except Unmatched as e:
        return [("error", None, 1, 0, {"message": str(e)})]
    for tag, fn, _, _, body in rows:
        if tag == "binding" and fn is not None and not body["is_wildcard"]:
            body["is_refcounted"] = body["name"] in reader.counted[fn]
    return rows + fingerprints(rows)


# ---------------------------------------------------------------- tables

_LIST, _PLACES = "array<string>", "name string"
SCHEMAS = {
    "error": "message string",
    "attribute": "name string, text string",
    "module": f"name string, is_cfg_test boolean, inline boolean, predicates {_LIST}",
    "definition": f"kind string, name string, owner string, predicates {_LIST}",
    "reference": f"kind string, origin string, text string, alias string, glob boolean, predicates {_LIST}",
    "function": f"name string, is_unsafe boolean, params array<struct<name: string, type: string>>, return_type string, type_names {_LIST}, item_depth int, has_arithmetic boolean, body_lines int, is_associated boolean, method_of string, is_forwarder boolean, visibility string, features {_LIST}, predicates {_LIST}",
    "type_def": f"name string, kind string, visibility string, features {_LIST}, predicates {_LIST}, edges {_LIST}",
    "type_alias": f"name string, edges {_LIST}",
    "impl_block": f"type string, trait string, predicates {_LIST}, edges {_LIST}",
    "control_flow": "kind string, depth int, loop_depth int, parent_branch string, has_else boolean, chain_len int, else_line int, else_col int",
    "binding": "name string, loop_depth int, is_refcounted boolean, is_wildcard boolean, has_init boolean, init_is_write_macro boolean, placed boolean",
    "type_ref": "text string, context string, involves_dyn boolean, is_vec_box_dyn boolean, is_default_hasher boolean",
    "method_call": "name string, text string, receiver string, loop_depth int",
    "macro": "text string",
    "string_literal": "value string",
    "unsafe_site": "kind string, text string",
    "extern_block": "text string",
    "fingerprint": "name string, skeleton string, exact string, fact_count int",
}


def extract(files: DataFrame) -> DataFrame:
    """file, ord, tag, fn, line, col, body (JSON): all facts of all ``.rs`` files among (path, source), in one pass.

    ``fn`` numbers the functions of a file from 0. Null sources are empty. Write
    the result to scratch where more than one table of it is read.
    """
    import pyarrow as pa

    ship(files.sparkSession)
    rows = files.where(F.col("path").endswith(".rs")).select("path", F.coalesce("source", F.lit("")).alias("source"))
    types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = [(path, k, tag, fn, line, col, json.dumps(body)) for k, (tag, fn, line, col, body) in enumerate(scan(source))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["file", "ord", "tag", "fn", "line", "col", "body"])

    return rows.mapInArrow(run, "file string, ord int, tag string, fn int, line int, col int, body string")


def table(facts: DataFrame, tag: str) -> DataFrame:
    """file, ord, fn, line, col and the columns of one kind of fact (see SCHEMAS)."""
    return facts.where(F.col("tag") == tag).select("file", "ord", "fn", "line", "col", F.from_json("body", SCHEMAS[tag]).alias("b")).select("file", "ord", "fn", "line", "col", "b.*")


def use_paths(facts: DataFrame) -> DataFrame:
    """file, fn, line, col, path: every import, and each expression path where a file first has it."""
    refs = table(facts, "reference").where("origin in ('import', 'expression_path')")
    first = Window.partitionBy("file", "origin", "text").orderBy("ord")
    kept = refs.withColumn("_n", F.row_number().over(first)).where("origin = 'import' or _n = 1")
    return kept.select("file", "fn", "line", "col", F.col("text").alias("path"))


def type_edges(facts: DataFrame) -> DataFrame:
    """file, src, dst: what type definitions, aliases and impl blocks say of types that belong together."""
    of = lambda tag, name: table(facts, tag).select("file", F.col(name).alias("src"), F.explode("edges").alias("dst"))
    return of("type_def", "name").unionByName(of("type_alias", "name")).unionByName(of("impl_block", "type"))


def pairs(names: Column) -> Column:
    """All pairs (i < j) of an array of names, as structs a, b."""
    later = lambda x, i: F.transform(F.slice(names, i + 2, F.size(names)), lambda y: F.struct(x.alias("a"), y.alias("b")))
    return F.flatten(F.transform(names, later))


def capability_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The five inputs of ``capability.detect``: use paths, unsafe sites, extern blocks, attributes, string literals."""
    shifted = lambda rows, *columns: rows.select(*columns, "file", "line", F.col("col").alias("col0"), "fn")
    return (
        shifted(use_paths(facts), "path"),
        shifted(table(facts, "unsafe_site"), "text"),
        shifted(table(facts, "extern_block"), "text"),
        shifted(table(facts, "attribute"), "name"),
        shifted(table(facts, "string_literal"), "value"),
    )


def crate_key(path: Column) -> Column:
    """The crate of a source: the directory that holds its ``src``, else its own directory."""
    return F.when(path.rlike("(^|/)src/"), F.regexp_extract(path, "^(.*?)/?src/", 1)).otherwise(F.regexp_replace(path, "/?[^/]*$", ""))
