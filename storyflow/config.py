"""Layered configuration: sectioned text to values, on the driver.

Sections are asked from the highest to the lowest priority. A few hundred keys
at most parameterise a job, so they never become a DataFrame, except through
:func:`as_rows` for checks.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "section string, key string, value string, line int"


def parse(text: str) -> dict[str, dict[str, str]]:
    """Sections of a text of ``[section]`` and ``key: value`` or ``key = value`` lines.

    Indented lines continue a value. ``;`` after white space begins a comment,
    ``#`` and ``rem`` at a line's start too. ``""`` is an empty value.
    """
    return {s: {k: v for k, (v, _) in keys.items()} for s, keys in _parsed(text).items()}


def _parsed(text: str) -> dict[str, dict[str, tuple[str, int]]]:
    out: dict[str, dict[str, tuple[str, int]]] = {}
    section, key = None, None
    for number, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line[0] in "#;" or re.match(r"(?i)rem\b", line):
            continue
        line = re.sub(r"\s;.*$", "", line).rstrip()
        if line[:1].isspace() and section is not None and key:
            if line.strip():
                value, at = out[section][key]
                out[section][key] = (f"{value}\n{line.strip()}" if value else line.strip(), at)
        elif m := re.fullmatch(r"\[(.+)\]", line.strip()):
            section, key = m[1], None
            out.setdefault(section, {})
        elif (m := re.match(r"([^:=\s][^:=]*?)\s*[:=]\s*(.*)$", line)) and section is not None:
            key = m[1].strip()
            out[section][key] = ("" if m[2] == '""' else m[2], number)
        else:
            raise ValueError(f"line {number}: {line!r}")
    return out


def sections_for(site: str, form: str = "", url: str = "", bases: tuple[str, ...] = ()) -> list[str]:
    """Section names from the highest priority to the lowest."""
    plain = site.removeprefix("www.")
    out = ["overrides", url]
    if form:
        out += [f"{plain}:{form}", f"www.{plain}:{form}", *(f"{b}:{form}" for b in bases), form]
    out += [plain, f"www.{plain}", *bases, "defaults", "injected"]
    return list(dict.fromkeys(s for s in out if s))


class Settings:
    """Values by key; later layers of the same section win over earlier ones."""

    def __init__(self, layers: list[str], sections: list[str], fetch: Callable[[str], str] | None = None, overrides: dict[str, str] | None = None):
        self.sections, self.fetch, self.known = sections, fetch, {}
        self.values: dict[str, dict[str, str]] = {}
        for layer in layers:
            for section, keys in parse(layer).items():
                self.values.setdefault(section, {}).update(keys)
        self.values.setdefault("overrides", {}).update(overrides or {})

    def get(self, key: str, default: str | None = "") -> str | None:
        """The first section's value, then every ``add_to_<key>``, lowest priority first.

        ``<key>_filelist`` names files whose joined contents come instead, if
        any can be fetched.
        """
        if key not in self.known:
            self.known[key] = self._get(key, default)
        return self.known[key]

    def _get(self, key: str, default: str | None) -> str | None:
        if self.fetch and not key.endswith("_filelist"):
            texts = []
            for name in self.list(f"{key}_filelist"):
                try:
                    texts.append(self.fetch(name))
                except OSError:
                    continue
            if texts:
                return "\n".join(texts)
        value = next((self.values[s][key] for s in self.sections if key in self.values.get(s, {})), default)
        for s in reversed(self.sections):
            value = (value or "") + self.values[s][f"add_to_{key}"] if f"add_to_{key}" in self.values.get(s, {}) else value
        return value

    def flag(self, key: str, default: bool = False) -> bool:
        value = self.get(key, None)
        return default if value is None else value.strip().lower() not in ("", "false")

    def list(self, key: str) -> list[str]:
        """Members between commas; ``\\,`` is a comma."""
        return [x for x in (p.replace("\\,", ",").strip() for p in re.split(r"(?<!\\),", self.get(key, "") or "")) if x]


def as_rows(spark: SparkSession, text: str) -> DataFrame:
    rows = [(s, k, v, n) for s, keys in _parsed(text).items() for k, (v, n) in keys.items()]
    return spark.createDataFrame(rows, SCHEMA)


def problems(rows: DataFrame, sections: DataFrame, keys: DataFrame, values: DataFrame) -> DataFrame:
    """(line, error) of unknown sections and keywords and values outside their vocabulary.

    ``values`` has key, value; a key without rows there takes any value.
    """
    bad_section = rows.join(sections, "section", "left_anti").select("line", F.concat(F.lit("unknown section: "), "section").alias("error"))
    bad_key = rows.where(~F.col("key").startswith("add_to_")).join(keys, "key", "left_anti").select("line", F.concat(F.lit("unknown keyword: "), "key").alias("error"))
    limited = rows.join(values.select("key").distinct(), "key", "left_semi")
    bad_value = limited.join(values, ["key", "value"], "left_anti").select("line", F.concat(F.lit("bad value: "), "value").alias("error"))
    return bad_section.unionByName(bad_key).unionByName(bad_value)
