"""Lines of the metadata rule language, parsed on the driver.

    [keys =>] regex => replacement [&& key OP value]      replacements
    keys OP value [&& key OP value]                       include and exclude

OP is one of ``=>`` and ``=~`` (regex found), ``!~`` (not found), ``==`` and
``!=``. ``\\s`` in a value or replacement is a space; ``\\,`` in a replacement
splits a value into several.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

OPERATORS = ("=>", "=~", "!~", "==", "!=")


@dataclass(frozen=True)
class Test:
    """``keys OP value``; on a list, true if it holds for a member, then negated."""

    keys: tuple[str, ...]
    value: str
    regex: bool
    negated: bool

    def holds(self, values: list[str]) -> bool:
        found = any(re.search(self.value, v, re.S) if self.regex else v == self.value for v in values)
        return bool(found) != self.negated


@dataclass(frozen=True)
class Filter:
    line: str
    test: Test
    condition: Test | None


@dataclass(frozen=True)
class Replacement:
    line: str
    keys: tuple[str, ...]
    regex: str
    parts: tuple[str, ...]
    condition: Test | None

    @property
    def splits(self) -> bool:
        return len(self.parts) > 1


@dataclass(frozen=True)
class Program:
    replacements: tuple[Replacement, ...] = ()
    include_pre: tuple[Filter, ...] = ()
    exclude_pre: tuple[Filter, ...] = ()
    include_post: tuple[Filter, ...] = ()
    exclude_post: tuple[Filter, ...] = ()


def _keys(text: str) -> tuple[str, ...]:
    return tuple(k.strip() for k in text.split(",") if k.strip())


def parse_test(text: str) -> Test:
    for op in OPERATORS:
        if op in text:
            keys, _, value = text.partition(op)
            return Test(_keys(keys), value.strip().replace("\\s", " ") if op in ("==", "!=") else _spaces(value.strip()), op in ("=>", "=~", "!~"), op in ("!~", "!="))
    raise ValueError(f"no operator in {text!r}")


def _spaces(value: str) -> str:
    """``\\s`` as a space, except after another backslash."""
    return re.sub(r"(?<!\\)((?:\\\\)*)\\s", r"\1 ", value)


def _lines(text: str):
    for line in text.splitlines():
        if line.strip() and not line.strip().startswith("#"):
            yield line.strip()


def parse_filters(text: str) -> tuple[Filter, ...]:
    out = []
    for line in _lines(text):
        head, *condition = line.split("&&")
        out.append(Filter(line, parse_test(head), parse_test(condition[0]) if condition else None))
    return tuple(out)


def parse_replacements(text: str) -> tuple[Replacement, ...]:
    out = []
    for line in _lines(text):
        head, *condition = line.split("&&")
        parts = [p.strip() for p in head.split("=>")]
        if len(parts) < 2:
            raise ValueError(f"no replacement in {line!r}")
        keys = _keys(parts[0]) if len(parts) > 2 else ()
        regex, to = parts[-2], parts[-1]
        re.compile(regex, re.S)
        out.append(Replacement(line, keys, regex, tuple(p.replace("\\s", " ") for p in to.split("\\,")), parse_test(condition[0]) if condition else None))
    return tuple(out)


def parse(replace: str = "", include_pre: str = "", exclude_pre: str = "", include_post: str = "", exclude_post: str = "") -> Program:
    return Program(parse_replacements(replace), *map(parse_filters, (include_pre, exclude_pre, include_post, exclude_post)))


#: Escapes of a Python replacement that stand for a character.
_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\"}
_PART = re.compile(r"\\g<(\w+)>|\\([1-9]\d?)|\\(.)|(.)", re.S)


def _java_replacement(to: str, regex: str) -> str:
    """A Python replacement in Java's syntax: group numbers, and all else as literals."""
    names, out, after_group = re.compile(regex, re.S).groupindex, [], False
    for name, number, escaped, plain in _PART.findall(to):
        if name or number:
            out.append(f"${names.get(name, name) if name else number}")
            after_group = True
            continue
        literal = plain or _ESCAPES.get(escaped) or "\\" + escaped
        for c in literal:
            out.append("\\" + c if c in "\\$" or after_group and c.isdigit() else c)
            after_group = False
    return "".join(out)


def java_regex(regex: str) -> str | None:
    """The pattern in Java's syntax; None if it has no counterpart."""
    if re.search(r"\(\?\(|\(\?P=|\(\?P<\w*_\w*>|\\[AZ0]", regex):
        return None
    out, at, inside = [], 0, False
    while at < len(regex):
        c = regex[at]
        if c == "\\":
            out.append(regex[at : at + 2])
            at += 2
            continue
        if inside:
            if c == "]":
                inside = False
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            inside = True
            head = re.match(r"\[\^?\]?", regex[at:])[0]
            out.append(head.replace("]", "\\]"))
            at += len(head)
            continue
        elif found := re.match(r"\(\?P<|\{,(?=\d+\})", regex[at:]):
            out.append("(?<" if found[0] == "(?P<" else "{0,")
            at += len(found[0])
            continue
        else:
            out.append(c)
        at += 1
    return "(?sdU)" + "".join(out)


def java(rule: Replacement) -> tuple[str, str] | None:
    regex = java_regex(rule.regex)
    return None if regex is None or rule.splits else (regex, _java_replacement(rule.parts[0], rule.regex))
