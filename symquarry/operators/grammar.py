"""Line grammars: tables of rules that turn the lines of a file into symbols.

A grammar says how to strip comments, which lines to skip, how scopes open and close, and lists its rules in
order of precedence. A rule is a pattern with templates for kind, name and qualified name, and says which
scope it opens and which part of the line holds parameters or a type. Only the engine walks lines.

Texts are held as latin-1 strings of the file's bytes, so every position is a byte offset and patterns see
what a byte-wise matcher would see.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

SPACES = " \t\n\v\f\r"
_RUNS = re.compile(r"[ \t\n\v\f\r]+")


def squeeze(text: str) -> str:
    return _RUNS.sub(" ", text).strip(SPACES)


@dataclass
class Line:
    text: str
    start: int


def split_lines(content: str) -> list[Line]:
    """Lines without their end; a closing carriage return counts for nothing, not even in offsets."""
    parts = content.split("\n")
    if parts and parts[-1] == "":
        parts.pop()
    out, at = [], 0
    for p in parts:
        p = p[:-1] if p.endswith("\r") else p
        out.append(Line(p, at))
        at += len(p) + 1
    return out


# Comment strippers, by the sign that starts a comment and the quotes that hide it.


def cut_at(sign: str) -> Callable[[str], str]:
    return lambda line: line.split(sign, 1)[0]


def cut_outside(pattern: str) -> Callable[[str], str]:
    """What stands before a comment; pattern matches everything that is no comment."""
    plain = re.compile(pattern, re.S)
    return lambda line: plain.match(line).group()


QUOTED = r"""(?:'[^']*(?:'|$)|"[^"]*(?:"|$)|[^'"%s])*"""
hash_outside_quotes = cut_outside(QUOTED % "#")
percent_outside_quotes = cut_outside(QUOTED % "%")
slashes_outside_quotes = cut_outside(r"""(?:'[^']*(?:'|$)|"[^"]*(?:"|$)|/(?!/)|[^'"/])*""")
slashes_outside_strings = cut_outside(r"""(?:"[^"]*(?:"|$)|/(?!/)|[^"/])*""")
slashes_outside_escaped = cut_outside(r"""(?:"(?:\\"|[^"])*(?:"|$)|\\"|/(?!/)|[^"/])*""")
php_comment = cut_outside(r"""(?:"(?:\\"|[^"])*(?:"|$)|\\"|/(?!/)|#$|[^"/#])*""")
whole = lambda line: line


def parameters(text: str, style: str) -> list[dict]:
    """Parameters of a list; every comma divides, whatever stands around it.

    Styles: name (all of it), value (name = default), colon (name: type), colon_value (name: type = default),
    last (type words, name last, = default), pair (the two last words; also directions and no `void`),
    pair_void, first (name first, type last; one word is a type), dollar (type $name = default).
    """
    out: list[dict] = []
    for part in (p.strip(SPACES) for p in text.split(",")):
        if not part or (style == "pair_void" and part == "void"):
            continue
        p = {"name": part, "type": "", "default_value": "", "position": len(out), "direction": ""}
        if style in ("value", "colon_value", "last", "pair", "pair_void", "dollar"):
            head, _, value = part.partition("=")
            p["name"], p["default_value"] = head.strip(SPACES), value.strip(SPACES)
        head = p["name"]
        words = [w for w in _RUNS.split(head) if w]
        if style in ("colon", "colon_value"):
            name, _, kind = head.partition(":")
            p["name"], p["type"] = name.strip(SPACES), kind.strip(SPACES)
        elif style == "last":
            p["name"], p["type"] = (words[-1], " ".join(words[:-1])) if words else ("", "")
        elif style in ("pair", "pair_void"):
            if not words:
                continue
            p["name"], p["type"] = words[-1], words[-2] if len(words) > 1 else ""
            if style == "pair" and len(words) > 1 and words[0] in ("ref", "out", "in"):
                p["direction"] = words[0]
        elif style == "first":
            p["name"], p["type"] = (words[0], words[-1]) if len(words) > 1 else ("", words[0] if words else "")
        elif style == "dollar" and "$" in head:
            p["name"], p["type"] = head[head.index("$") :], head[: head.index("$")].strip(SPACES)
        out.append(p)
    return out


@dataclass
class Scope:
    kind: str
    name: str
    qualified: str
    symbol: int
    close: int
    line: int


@dataclass
class Rule:
    """One row of a grammar.

    kind, name: format strings over the match's groups ({1}), or functions of (walk, match). A kind of None
    leaves the line to later rules; an empty name takes it without a symbol; a list of names gives one symbol
    each. act: called in place of all this. within: qualify by "type", "scope" (any), "package", "type or package",
    "section" or nothing. only: a condition on the walk and the match. opens: the line opens a scope.
    block: the symbol ends with its block. falls: later rules are tried as well.
    """

    kind: str | Callable
    pattern: str
    name: str | Callable = "{1}"
    within: str = ""
    returns: str | Callable = ""
    params: tuple[int | Callable, str] | None = None
    only: Callable | None = None
    opens: bool | Callable = False
    block: bool | Callable = False
    falls: bool = False
    child: bool = True
    flags: int = 0
    on: str = "code"
    also: Callable | None = None
    extra: Callable | None = None
    act: Callable | None = None
    qualified: Callable | None = None

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | self.flags)


@dataclass
class Grammar:
    """scopes: "" (none), "before" or "after" (braces; closed before or after the line that lowers the depth),
    "indent", "end" (a closing line). types: kinds that own members. blocks: "count" or "match", two ways of
    finding the end of a block."""

    language: str
    rules: list[Rule]
    strip: Callable[[str], str] = whole
    skip: Callable[[str], bool] = lambda t: not t
    separator: str = "."
    scopes: str = ""
    types: tuple[str, ...] = ()
    owners: tuple[str, ...] = ()
    blocks: str = "count"
    closes: Callable | None = None
    keeps_open: Callable | None = None
    counts_skipped: bool = True
    squeezes: bool = True
    ends_with_code: bool = False
    each_line: Callable | None = None
    start: Callable | None = None
    finish: Callable | None = None


def fill(template, walk: "Walk", m: re.Match) -> str | None:
    if callable(template):
        return template(walk, m)
    return template.format(*(g or "" for g in (m.group(0), *m.groups())))


@dataclass
class Walk:
    """One file on its way through a grammar."""

    grammar: Grammar
    path: str
    lines: list[Line]
    symbols: list[dict] = field(default_factory=list)
    stack: list[Scope] = field(default_factory=list)
    depth: int = 0
    at: int = 0
    code: str = ""
    vars: dict = field(default_factory=dict)

    @cached_property
    def stripped(self) -> list[str]:
        return [self.grammar.strip(line.text) for line in self.lines]

    @property
    def type(self) -> Scope | None:
        return next((s for s in reversed(self.stack) if s.kind in self.grammar.types), None)

    @property
    def owner(self) -> Scope | None:
        """The nearest scope that lends its name; types, and whatever else the grammar lists."""
        names = self.grammar.owners or self.grammar.types
        return next((s for s in reversed(self.stack) if s.kind in names), None)

    @property
    def indent(self) -> int:
        text = self.lines[self.at].text
        return sum(4 if c == "\t" else 1 for c in text[: len(text) - len(text.lstrip(" \t"))])

    # ends of blocks

    @cached_property
    def _braces(self) -> list[tuple[int, bool]]:
        return [(t.count("{") - t.count("}"), "{" in t) for t in self.stripped]

    @cached_property
    def _matched(self) -> list[int]:
        """For each line the line that closes the last block opened on it; for others the next such end."""
        ends, waiting = [0] * len(self.lines), []
        for number, text in enumerate(self.stripped):
            for sign in re.findall("[{}]", text):
                if sign == "{":
                    waiting.append(number)
                elif waiting:
                    ends[waiting.pop()] = number + 1
        following = 0
        for number in reversed(range(len(ends))):
            ends[number] = following = ends[number] or following
        return ends

    def block_end(self, at: int) -> int:
        if self.grammar.blocks == "match":
            return self._matched[at] or at + 1
        depth, seen = 0, False
        for number in range(at, len(self.lines)):
            change, opened = self._braces[number]
            depth, seen = depth + change, seen or opened
            if seen and depth <= 0:
                return number + 1
        return at + 1

    def indented_end(self, at: int) -> int:
        own, last = self.indent, at
        for number in range(at + 1, len(self.lines)):
            text = self.lines[number].text
            body = text.strip(SPACES)
            if not body or body.startswith("#"):
                continue
            if sum(4 if c == "\t" else 1 for c in text[: len(text) - len(text.lstrip(" \t"))]) <= own:
                break
            last = number
        return last + 1

    # symbols

    def end_at(self, index: int, line: int, text: str | None = None) -> None:
        s = self.symbols[index]
        s["line_end"] = line
        end = self.lines[line - 1] if 0 < line <= len(self.lines) else Line("", 0)
        s["char_end"] = end.start + len(end.text)
        s["char_count"] = max(0, s["char_end"] - s["char_start"])

    def emit(self, kind: str, name: str, qualified: str | None = None, parent: int = -1, line: int | None = None, signature: str | None = None, **more) -> int:
        at = self.at if line is None else line
        here = self.lines[at] if at < len(self.lines) else Line("", 0)
        place = here.text.find(more.pop("find", name))
        place = more.pop("otherwise", 0) if place < 0 else place
        text = self.code if signature is None else signature
        symbol = {
            "kind": kind, "name": name, "qualified_name": qualified or name, "signature": squeeze(text) if self.grammar.squeezes else text.strip(SPACES),
            "return_type": "", "visibility": "", "modifiers": "", "line_start": at + 1, "line_end": at + 1,
            "char_start": here.start + place, "char_end": here.start + len(self.stripped[at] if self.grammar.ends_with_code else here.text), "char_count": 0, "parent_index": parent,
            "base_types": [], "parameters": [],
        }
        symbol["char_count"] = max(0, symbol["char_end"] - symbol["char_start"])
        self.symbols.append(symbol | more)
        return len(self.symbols) - 1

    def qualify(self, within: str, name: str) -> str:
        owner = self.type if within.startswith("type") else self.owner
        package = self.vars.get("package", "")
        above = {
            "": "", "package": package, "type": owner.qualified if owner else "", "scope": owner.qualified if owner else "",
            "type or package": owner.qualified if owner else package, "section": self.vars.get("section", ""),
        }[within]
        return f"{above}{self.grammar.separator}{name}" if above else name

    def parent(self, rule: Rule) -> int:
        if not rule.child or rule.within in ("", "package"):
            return -1
        if rule.within == "section":
            return self.vars.get("section_symbol", -1)
        owner = self.type if rule.within.startswith("type") else self.owner
        return owner.symbol if owner else -1

    def apply(self, rule: Rule, m: re.Match) -> bool:
        """Whether the rule has taken the line."""
        if rule.act:
            rule.act(self, m)
            return True
        kind = fill(rule.kind, self, m)
        if kind is None:
            return False
        names = fill(rule.name, self, m)
        for name in names if isinstance(names, list) else [names]:
            if name:
                self.one(rule, m, kind, name)
        return True

    def one(self, rule: Rule, m: re.Match, kind: str, name: str) -> None:
        qualified, parent = rule.qualified(self, m, name) if rule.qualified else self.qualify(rule.within, name), self.parent(rule)
        more = rule.extra(self, m) if rule.extra else {}
        index = self.emit(kind, name, qualified, parent, **more)
        symbol = self.symbols[index]
        if rule.returns:
            symbol["return_type"] = (fill(rule.returns, self, m) or "").strip(SPACES)
        if rule.params:
            group, style = rule.params
            symbol["parameters"] = parameters(group(m) if callable(group) else m.group(group) or "", style)
        if rule.block(self, m) if callable(rule.block) else rule.block:
            self.end_at(index, self.indented_end(self.at) if self.grammar.scopes == "indent" else self.block_end(self.at))
        opens = rule.opens(self, m) if callable(rule.opens) else rule.opens
        if opens is not False and opens is not None:  # a number is the depth at which the scope closes, 0 for never
            close = self.indent if self.grammar.scopes == "indent" else self.depth + 1 if opens is True else opens
            self.stack.append(Scope(kind, name, qualified, index, close, self.at + 1))
        if rule.also:
            rule.also(self, m, index)

    # scopes

    def close_braces(self, end: int) -> None:
        while self.stack and self.stack[-1].close > 0 and self.at + 1 > self.stack[-1].line and self.depth < self.stack[-1].close:
            scope = self.stack.pop()
            self.end_at(scope.symbol, max(scope.line, end))

    def close_one(self, end: int) -> None:
        if self.stack:
            scope = self.stack.pop()
            if scope.symbol >= 0:
                self.end_at(scope.symbol, max(self.symbols[scope.symbol]["line_start"], end))

    def close_indent(self, indent: int, line: int) -> None:
        while self.stack and line > self.stack[-1].line and indent <= self.stack[-1].close:
            scope = self.stack.pop()
            self.end_at(scope.symbol, max(scope.line, line - 1))

    def run(self) -> list[dict]:
        g = self.grammar
        if g.start:
            g.start(self)
        for self.at, line in enumerate(self.lines):
            stripped = self.stripped[self.at]
            self.code = stripped.strip(SPACES)
            change = stripped.count("{") - stripped.count("}") if g.scopes in ("before", "after") else 0
            if g.skip(self.code):
                self.depth += change if g.counts_skipped else 0
                continue
            if g.scopes == "before" and not (g.keeps_open and g.keeps_open(self.code)):
                self.close_braces(self.at)
            elif g.scopes == "indent":
                self.close_indent(self.indent, self.at + 1)
            if not (g.each_line and g.each_line(self)):
                for rule in g.rules:
                    if rule.only and not rule.only(self):
                        continue
                    m = rule.regex.search(line.text if rule.on == "line" else self.code)
                    if m and self.apply(rule, m) and not rule.falls:
                        break
            self.depth += change
            if g.scopes == "after":
                self.close_braces(self.at + 1)
        if g.scopes == "indent":
            self.close_indent(0, len(self.lines) + 1)
        while g.scopes == "end" and self.stack:
            self.close_one(len(self.lines))
        if g.finish:
            g.finish(self)
        return self.symbols

