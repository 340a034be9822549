"""List functions: de-duplication, joining, unions, ships and pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(values: Column) -> Column:
    """Without nulls and empty texts."""
    return F.filter(values, lambda x: x.isNotNull() & (x != ""))


def finished(values: Column, keep_order: bool = False) -> Column:
    """Present members once each: in order of first sight, or sorted by code point."""
    distinct = F.array_distinct(present(values))
    return distinct if keep_order else F.array_sort(distinct)


def joined(values: Column, by: str = ", ") -> Column:
    return F.array_join(values, by)


def appended(values: Column, more: list[str]) -> Column:
    """``values`` and those of ``more`` that it lacks."""
    return F.array_union(values, F.array(*map(F.lit, more)).cast("array<string>"))


def united(*lists: Column) -> Column:
    return F.concat(*lists)


def flagged(values: Column, others: Column, flag: str) -> Column:
    """``values`` and ``flag`` where ``others`` has several members."""
    return F.when(F.size(others) > 1, F.array_append(values, F.lit(flag))).otherwise(values)


def ships(values: Column, split: str = "/", by: str = "/", names=lambda x: x) -> Column:
    """Pairings with their sides sorted; sides go through ``names`` where there are several."""

    def one(x: Column) -> Column:
        sides = F.split(x, split)
        return F.when(F.size(sides) > 1, F.array_join(F.array_sort(F.transform(sides, names)), by)).otherwise(x)

    return F.transform(values, one)


def pair_and_sides(values: Column) -> tuple[Column, Column]:
    """Pairings ``a/b`` and the characters that they name."""
    return F.filter(values, lambda x: x.contains("/")), F.array_distinct(F.flatten(F.transform(values, lambda x: F.split(x, "/"))))


def subject_tags(entries: dict[str, Column], wanted: list[str], extra: list[str] = ()) -> Column:
    """Ordered set of the members of entries; ``name.SPLIT`` splits at commas, ``name_LIST`` joins."""
    parts = []
    for name in wanted:
        if name.endswith(".SPLIT"):
            parts.append(F.flatten(F.transform(entries[name[:-6]], lambda x: F.split(x, ","))))
        elif name.endswith("_LIST"):
            parts.append(F.array(joined(entries[name[:-5]])))
        else:
            parts.append(entries[name])
    parts.append(F.array(*map(F.lit, extra)).cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(F.concat(*parts), lambda x: F.trim(x)), lambda x: x != ""))


def intersection(lists: Column) -> Column:
    """Members of every list of an array of lists, in the first one's order."""
    return F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0))), F.element_at(lists, 1), F.array_intersect)


def case_insensitive_union(old: Column, new: Column) -> Column:
    """Old and new tags, each once whatever its case: the old spelling at the new place."""
    kept = F.filter(old, lambda o: ~F.exists(new, lambda n: F.lower(n) == F.lower(o)))
    spelled = F.transform(new, lambda n: F.coalesce(F.try_element_at(F.filter(old, lambda o: F.lower(o) == F.lower(n)), F.lit(1)), n))
    return F.concat(kept, spelled)


def superseded(old: Column, new: Column, groups: list[list[str]]) -> Column:
    """``old`` without the members of groups of which ``new`` has some."""
    for group in groups:
        names = F.array(*map(F.lit, group))
        old = F.when(F.arrays_overlap(new, names), F.array_except(old, names)).otherwise(old)
    return old


def links(names: Column, urls: Column) -> Column:
    """``<a>`` elements of names and urls by position; a missing url is ``None``."""
    return F.transform(names, lambda n, i: F.concat(F.lit('<a href="'), F.coalesce(F.try_element_at(urls, i + 1), F.lit("None")), F.lit('">'), n, F.lit("</a>")))


def if_same_size(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value)


def key_values(flat: Column) -> Column:
    """Map of a list of keys and values in turn."""
    odd = lambda want: F.filter(F.transform(flat, lambda x, i: F.when(i % 2 == want, x)), lambda x: x.isNotNull())
    return F.map_from_arrays(odd(0), odd(1))


def sorted_parameters(url: Column, parameters: Column) -> Column:
    """Cache key: the url with its parameters by name."""
    pairs = F.array_sort(F.transform(F.map_entries(parameters), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.when(F.size(pairs) > 0, F.concat(url, F.lit("?"), F.array_join(pairs, "&"))).otherwise(url)


def fraction_status(text: Column) -> Column:
    """``7/7`` is Completed, anything else In-Progress."""
    parts = F.split(text, "/")
    return F.when(F.try_element_at(parts, F.lit(1)) == F.try_element_at(parts, F.lit(2)), "Completed").otherwise("In-Progress")


def numbered_keys(values: Column, prefix: str) -> Column:
    """Values of the keys prefix00, prefix01, ... of a map, up to the first gap."""
    found = F.transform(F.sequence(F.lit(0), F.greatest(F.size(values), F.lit(1))), lambda i: F.try_element_at(values, F.concat(F.lit(prefix), F.lpad(i.cast("string"), 2, "0"))))
    gap = F.array_position(F.transform(found, lambda x: F.coalesce(x, F.lit("\0"))), "\0")
    return F.slice(found, F.lit(1), F.when(gap > 0, gap.cast("int") - 1).otherwise(F.size(found)))


def list_sum(text: Column) -> Column:
    """Sum of the numbers of a comma list."""
    return F.aggregate(_numbers(text), F.lit(0.0), lambda a, x: a + x)


def list_mean(text: Column) -> Column:
    return F.when(F.size(_numbers(text)) > 0, list_sum(text) / F.size(_numbers(text)))


def list_max(text: Column) -> Column:
    return F.array_max(_numbers(text))


def _numbers(text: Column) -> Column:
    return F.array_compact(F.transform(F.split(text, ","), lambda x: F.replace(x, F.lit(" "), F.lit("")).try_cast("double")))


def bool_words(text: Column) -> Column:
    """t, true, 1, yes, y and f, false, 0, no, n; else null."""
    word = F.lower(F.trim(text))
    return F.when(word.isin("t", "true", "1", "yes", "y"), True).when(word.isin("f", "false", "0", "no", "n"), False)


def first_match(value: Column, cases: list[tuple[str, str]]) -> Column:
    """Setting of the first case whose pattern is found."""
    return reduce(lambda acc, c: F.when(value.rlike("(?s)" + c[0]), c[1]).otherwise(acc), reversed(cases), F.lit(None).cast("string"))


def escalated(flags: dict[str, Column], order: list[str]) -> tuple[Column, Column]:
    """Names of the flags that are set, and the last of ``order`` among them."""
    names = F.array_compact(F.array(*(F.when(c, n) for n, c in flags.items())))
    return names, reduce(lambda acc, n: F.when(F.array_contains(names, n), n).otherwise(acc), order, F.lit(None).cast("string"))


def default_value(value: Column, default: str) -> Column:
    """``default`` for an entry that was never set; an empty one was."""
    return F.coalesce(value, F.lit(default))


def framed(values: Column, first: str, last: str) -> Column:
    """A list between two marks."""
    return F.concat(F.array(F.lit(first)), values, F.array(F.lit(last)))


def longest_first(names: Column) -> Column:
    """Names by falling length, then in reverse order, so that no name hides a longer one."""
    return F.transform(F.reverse(F.array_sort(F.transform(names, lambda n: F.struct(F.length(n).alias("k"), n.alias("n"))))), lambda x: x["n"])
