"""Rules of many sites as one matcher: validity, canonical url, section url and section name.

Rules are configuration, a list. A url's site is the longest suffix of its host that
a rule names, looked up in one hashed set; the site's own rules, in their order, are
all that is tried. A url gives one row, with nulls where no rule fits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyflow.functions import urls
from storyflow.operators.lookups import small


@dataclass(frozen=True)
class SiteRule:
    """A site's form of url (a pattern from its start) and what it becomes.

    ``canonical`` and ``section`` may use groups as ``$1``; without ``section``, the
    canonical url names the section.
    """

    domain: str
    pattern: str
    canonical: str
    section: str | None = None


def _table(spark, rules: list[SiteRule]) -> DataFrame:
    by: dict[str, list[tuple[str, str, str]]] = {}
    for r in rules:
        by.setdefault(r.domain.lower().removeprefix("www."), []).append((f"^(?:{r.pattern}).*$", r.canonical, r.section or r.canonical))
    return spark.createDataFrame(list(by.items()), "_domain string, _rules array<struct<pattern:string,canonical:string,section:string>>")


def host_suffixes(host: Column) -> Column:
    """A host and its parents, the longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def matched(df: DataFrame, rules: list[SiteRule], url: str = "url") -> DataFrame:
    """``df`` with site, valid, canonical, section_url and section.

    ``site`` is the domain of the rules, ``valid`` whether one of them fits;
    ``section`` is the section's name in configurations, the domain without a rule.
    """
    domains = sorted({r.domain.lower().removeprefix("www.") for r in rules})
    host = urls.base_domain(F.col(url))
    found = df.withColumn("site", F.try_element_at(F.filter(host_suffixes(host), lambda s: s.isin(domains)), F.lit(1)))
    table = small(_table(df.sparkSession, rules))
    joined = found.join(table, F.col("site") == F.col("_domain"), "left")
    joined = joined.withColumn("_hit", F.try_element_at(F.filter("_rules", lambda r: F.rlike(F.col(url), r["pattern"])), F.lit(1)))
    become = lambda part: F.regexp_replace(F.col(url), F.col("_hit.pattern"), F.col(f"_hit.{part}"))
    out = joined.withColumns({"valid": F.col("_hit").isNotNull(), "canonical": become("canonical"), "section_url": become("section")})
    return out.withColumn("section", F.coalesce("section_url", "site", F.nullif(host, F.lit("")))).drop("_domain", "_rules", "_hit")


def renamed_sections(rows: DataFrame, rules: list[SiteRule]) -> DataFrame:
    """Configuration rows whose sections are urls under the section's canonical name; others, and unknown urls, stay."""
    named = matched(rows.withColumn("_url", F.col("section")).drop("section"), rules, "_url")
    known = F.col("_url").rlike("^https?://") & F.col("section_url").isNotNull()
    return named.withColumn("section", F.when(known, F.col("section_url")).otherwise(F.col("_url"))).select(rows.columns)
