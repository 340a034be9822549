"""Rule programs as Columns, with an interpreter where Columns can't follow.

A program becomes a fold of ``regexp_replace`` and ``when``. Programs that split
values, or whose patterns Java lacks, run in an Arrow UDF over the same
semantics. Conditions see the presented values of other entries; a condition on
the entry itself always holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyflow.functions import arrays
from storyflow.functions.udf import lazy
from storyflow.rules import language
from storyflow.rules.language import Filter, Program, Test

_LIST = "array<string>"
#: Longer programs are interpreted: as Columns they would outgrow a compiled method.
MOST_LINES = 100
#: A pattern that is found nowhere.
NEVER = "(?!)"


def test_column(test: Test, value: Column, is_list: bool) -> Column | None:
    """Whether a test holds for a value; None if its pattern has no Java form."""
    pattern = language.java_regex(test.value) if test.regex else test.value
    if pattern is None:
        return None

    def one(x: Column) -> Column:
        return x.rlike(pattern) if test.regex else x == pattern

    found = F.exists(value, one) if is_list else one(value)
    found = F.coalesce(found, F.lit(False))
    return ~found if test.negated else found


class Entries:
    """Columns of a row by entry name; arrays are lists."""

    def __init__(self, df: DataFrame, names: list[str]):
        kinds = dict(df.dtypes)
        self.lists = {n for n in names if kinds[n].startswith("array")}
        self.names = list(names)

    def column(self, name: str) -> Column:
        return F.col(f"`{name}`")


def _condition(test: Test | None, key: str, entries: Entries) -> Column:
    """A guard: true without one, and for one on the key itself."""
    if test is None or key in test.keys:
        return F.lit(True)
    found = [test_column(test, entries.column(k), k in entries.lists) for k in test.keys if k in entries.names]
    return F.coalesce(*found[:1], F.lit(False)) if found else F.lit(False)


def _kept(filters: tuple[Filter, ...], key: str, entries: Entries, value: Column, include: bool) -> Column:
    """Whether a value passes include lines (some matching, if any applies) or exclude lines (none)."""
    applied, matched = F.lit(False), F.lit(False)
    for f in filters:
        if key in f.test.keys:
            own = _condition(f.condition, key, entries)
            applied = applied | own
            matched = matched | (own & test_column(f.test, value, False))
    return (~applied | matched) if include else ~matched


def is_columnar(program: Program, key: str) -> bool:
    """Whether the lines that concern an entry are few and all have Column forms."""
    lines = [r for r in program.replacements if not r.keys or key in r.keys]
    filters = [f for group in (program.include_pre, program.exclude_pre, program.include_post, program.exclude_post) for f in group if key in f.test.keys]
    tests = [t for x in [*lines, *filters] for t in (x.condition, getattr(x, "test", None)) if t]
    return len(lines) + len(filters) <= MOST_LINES and all(language.java(r) for r in lines) and all(not t.regex or language.java_regex(t.value) for t in tests)


def scalar_column(program: Program, key: str, entries: Entries, value: Column) -> Column:
    """A presented value, null where a filter drops it."""
    keep = _kept(program.include_pre, key, entries, value, True) & _kept(program.exclude_pre, key, entries, value, False)
    out = value
    for rule in program.replacements:
        if not rule.keys or key in rule.keys:
            regex, to = language.java(rule)
            if rule.condition is None or key in rule.condition.keys:
                out = F.regexp_replace(out, regex, to)
            else:  # ``out`` once only, else its size would double with every rule
                own = F.when(_condition(rule.condition, key, entries), F.lit(regex)).otherwise(F.lit(NEVER))
                out = F.regexp_replace(out, own, F.lit(to))
    keep = keep & _kept(program.include_post, key, entries, out, True) & _kept(program.exclude_post, key, entries, out, False)
    return F.when(keep, out)


def interpret(program: Program, key: str, value: str, others: dict[str, list[str]], seen: tuple[str, ...] = ()) -> list[str]:
    """Presented values of one value; lines in ``seen`` are passed over."""

    def guarded(test: Test | None) -> bool:
        return test is None or key in test.keys or test.holds(next((others[k] for k in test.keys if k in others), []))

    def passes(filters: tuple[Filter, ...], x: str, include: bool) -> bool:
        own = [f for f in filters if key in f.test.keys and f.line not in seen and guarded(f.condition)]
        found = any(f.test.holds([x]) for f in own)
        return (not own or found) if include else not found

    if not passes(program.include_pre, value, True) or not passes(program.exclude_pre, value, False):
        return []
    out = [value]
    for rule in program.replacements:
        if rule.line in seen or (rule.keys and key not in rule.keys) or not re.search(rule.regex, out[0], re.S) or not guarded(rule.condition):
            continue
        if rule.splits:
            made = [re.sub(rule.regex, p, out[0], flags=re.S) for p in rule.parts]
            out = [x for m in made for x in interpret(program, key, m, others, (*seen, rule.line))]
            break
        out = [re.sub(rule.regex, rule.parts[0], out[0], flags=re.S)]
    return [x for x in out if passes(program.include_post, x, True) and passes(program.exclude_post, x, False)]


def list_udf(program: Program, key: str):
    """Column function (array of values, map of other entries) -> array of presented values."""

    def mapped(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for values, others in batches:
            out = []
            for mine, rest in zip(values.to_pylist(), others.to_pylist()):
                known = {k: [x for x in v or [] if x is not None] for k, v in rest or []}
                out.append(None if mine is None else [y for x in mine if x is not None for y in interpret(program, key, x, known)])
            yield pa.array(out, pa.list_(pa.string()))

    mapped.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(mapped, _LIST)


def _conditions(program: Program, key: str) -> set[str]:
    """Other entries that the lines for an entry look at."""
    lines = [r for r in program.replacements if not r.keys or key in r.keys]
    lines += [f for group in (program.include_pre, program.exclude_pre, program.include_post, program.exclude_post) for f in group if key in f.test.keys]
    return {k for x in lines if x.condition and key not in x.condition.keys for k in x.condition.keys}


def _order(program: Program, names: list[str], unions: dict[str, list[str]]) -> list[str]:
    """Entries so that each comes after those it looks at; cycles keep the given order."""
    done: list[str] = []

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in done or name in above:
            return
        for other in names:
            if other in _conditions(program, name) or other in unions.get(name, ()):
                visit(other, (*above, name))
        done.append(name)

    for n in names:
        visit(n, ())
    return done


def present(df: DataFrame, program: Program, names: list[str], keep_order: tuple[str, ...] = ("author", "authorId", "authorUrl"), unions: dict[str, list[str]] | None = None) -> DataFrame:
    """``df`` with its entries as readers see them.

    Lists are filtered, replaced, split, and finished (sorted, or in order of
    first sight for ``keep_order``). Scalars that a filter drops become ''.
    ``unions`` names lists that are made of other entries or "literals".
    """
    unions = unions or {}
    for name, sources in unions.items():
        parts = [F.array(F.lit(s[1:-1])) if s.startswith('"') else F.col(s) if dict(df.dtypes)[s].startswith("array") else F.array(F.col(s)) for s in sources]
        df = df.withColumn(name, F.concat(*(F.coalesce(p, F.array().cast(_LIST)) for p in parts)))
    names = names + [n for n in unions if n not in names]
    for name in _order(program, names, unions):
        entries = Entries(df, names)
        own = entries.column(name)
        if is_columnar(program, name):
            if name in entries.lists:
                value = arrays.finished(_each(program, name, entries, own), name in keep_order)
            else:
                value = F.coalesce(scalar_column(program, name, entries, own), F.lit(""))
        else:
            looked = sorted(k for k in _conditions(program, name) if k in names)
            pairs = [F.struct(F.lit(k).alias("k"), (entries.column(k) if k in entries.lists else F.array(entries.column(k))).alias("v")) for k in looked]
            others = F.map_from_entries(F.array(*pairs)) if pairs else F.create_map().cast("map<string,array<string>>")
            made = list_udf(program, name)(own if name in entries.lists else F.array(own), others)
            value = arrays.finished(made, name in keep_order) if name in entries.lists else F.array_join(arrays.present(made), ", ")
        df = df.withColumn(name, value)
    return df


def _each(program: Program, name: str, entries: Entries, values: Column) -> Column:
    return F.transform(values, lambda x: scalar_column(program, name, entries, x))


def joined_list(df: DataFrame, program: Program, name: str, by: str = ", ") -> Column:
    """A list as one text, to which the rules for ``<name>_LIST`` are then applied."""
    key = f"{name}_LIST"
    entries = Entries(df, [n for n, k in df.dtypes if k in ("string", _LIST)])
    return F.coalesce(scalar_column(program, key, entries, F.array_join(F.col(name), by)), F.lit(""))


def chapter_text(text: Column, lines: str) -> Column:
    """Ordered replacements on a chapter's title or text, without keys or conditions."""
    for rule in language.parse_replacements(lines):
        found = language.java(rule)
        text = F.regexp_replace(text, *found) if found else _python_replace(rule)(text)
    return text


def _python_replace(rule: language.Replacement):
    """Column function for a replacement that Java can't say; a split rule's parts are joined by a comma."""
    pattern, to = re.compile(rule.regex, re.S), ",".join(rule.parts)

    def replaced(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else pattern.sub(to, x) for x in batch.to_pylist()], pa.string())

    replaced.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return lazy(replaced, "string")
