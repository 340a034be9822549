"""WARC records and a Merkle fixity audit of two replicas of an archive.

Pages become WARC records; an archive holds them in the order of page id. A leaf
is a page id with all its records: their number, their bytes, and a multiset
hash of their digests (chunks of SHA-256 combined by xor), so that leaves are
aggregates with a partial step and one id may hold any share of the rows. A node
hashes its children's places, lengths and hashes in order, and so an ordered
range of offsets. One root stands for a replica. An audit compares the roots and
joins, level by level, just the children of nodes that differ; on the way down
the lengths of the children before give a leaf's offset in each replica.

As leaves stand at their page id, a lost record is one missing leaf. Records
behind it have other offsets, but they are intact and aren't reported.

Defined cases: null urls and bodies are empty; pages without an id share
``NULL_LEAVES`` leaves of a branch of their own, by digest, before all others.
Repeated rows are records of their own. A leaf that only one replica has is
``missing`` or ``extra``, one that differs ``changed``; ``digest`` is the least of
its records' digests. Empty tables have no roots and no differences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyflow.shared import cut, drop, table

FAN, NULL_LEAVES = 16, 1024
#: Hexadecimal digits of each of the four numbers that a digest is cut into.
DIGITS = 15


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A page's WARC resource record, as text."""
    body = F.coalesce(html, F.lit(""))
    head = ["WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:", F.coalesce(page_id.cast("string"), F.lit("")), ">\r\nWARC-Target-URI: ", F.coalesce(url, F.lit("")), "\r\nContent-Type: text/html\r\nContent-Length: ", F.octet_length(body).cast("string"), "\r\n\r\n"]
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in head), body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Columns page_id, record."""
    return pages.select(F.col(page_id).cast("bigint").alias("page_id"), record(F.col(page_id), F.col(url), F.col(html)).alias("record"))


def index(archive: DataFrame) -> DataFrame:
    """Leaves of :func:`records`: known (0 without an id, else 1), node, page_id, records, length, digest, hash."""
    own = archive.select("page_id", F.octet_length("record").cast("bigint").alias("length"), F.sha2("record", 256).alias("digest"))
    node = F.coalesce("page_id", F.pmod(F.xxhash64("digest"), F.lit(NULL_LEAVES)))
    known = F.col("page_id").isNotNull().cast("int")
    same = own.groupBy(known.alias("known"), node.alias("node"), "page_id", "digest").agg(F.count("*").alias("records"), F.sum("length").alias("length"))
    own_hash = F.sha2(F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "digest", F.col("records").cast("string")), 256)
    chunks = [F.conv(F.substring("h", 1 + DIGITS * k, DIGITS), 16, 10).cast("bigint") for k in range(4)]
    sums = [F.sum("records").alias("records"), F.sum("length").alias("length"), F.min("digest").alias("digest"), *(F.bit_xor(c).alias(f"x{k}") for k, c in enumerate(chunks))]
    leaves = same.withColumn("h", own_hash).groupBy("known", "node").agg(F.min("page_id").alias("page_id"), *sums)
    mixed = F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in ("records", "length", "x0", "x1", "x2", "x3"))), 256)
    return leaves.select("known", "node", "page_id", "records", "length", "digest", mixed.alias("hash"))


def parents(level: DataFrame) -> DataFrame:
    """The next level of nodes above (known, node, length, hash)."""
    children = F.array_sort(F.collect_list(F.struct("node", "length", "hash")))  # FAN at most
    line = F.transform(children, lambda c: F.concat_ws(":", F.pmod(c["node"], F.lit(FAN)).cast("string"), c["length"].cast("string"), c["hash"]))
    above = F.floor(F.col("node") / FAN).cast("bigint")
    return level.groupBy("known", above.alias("above")).agg(F.sum("length").alias("length"), F.sha2(F.array_join(line, ","), 256).alias("hash")).select("known", F.col("above").alias("node"), "length", "hash")


def depth_of(*leaves: DataFrame) -> int:
    """Levels above the leaves until only the nodes -1 and 0 are left in all of them."""
    depth = 0
    for own in leaves:
        low, high = own.agg(F.min("node"), F.max("node")).first()
        low, high, k = min(low or 0, 0), max(high or 0, 0), 0
        while low < -1 or high > 0:
            low, high, k = low // FAN, high // FAN, k + 1
        depth = max(depth, k)
    return depth


def tree(leaves: DataFrame, depth: int) -> tuple[list[DataFrame], list[str]]:
    """Levels from the leaves up, and where those above the leaves lie; ``leaves`` should be a written table."""
    levels, paths = [leaves], []
    for _ in range(depth):
        level, path = cut(parents(levels[-1].select("known", "node", "length", "hash")), "merkle")
        levels.append(level)
        paths.append(path)
    return levels, paths


def root(levels: list[DataFrame]) -> str | None:
    """The replica's root: a hash of its top nodes, three at most."""
    top = sorted((r.known, r.node, r.length, r.hash) for r in levels[-1].select("known", "node", "length", "hash").limit(3).collect())
    return levels[0].sparkSession.range(1).select(F.sha2(F.lit(repr(top)), 256)).first()[0] if top else None


def audit(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """Leaves that differ: page_id, status and both sides' offset, length, records, digest (``_a``, ``_b``).

    The nodes that differ on a level are written before the next one is looked at,
    so a level's plan is two joins, however deep the trees are.
    """
    spark = ours[0].sparkSession
    same = root(ours) == root(theirs)
    suspects = path = None
    for a, b in zip(reversed(ours), reversed(theirs)):
        sides = []
        for side, level in (("a", a), ("b", b)):
            before = F.lit(0).cast("bigint")
            parent = [F.lit(0)]
            if suspects is not None:
                under = suspects.select(F.col("known").alias("_known"), F.col("node").alias("_above"), F.coalesce(f"offset_{side}", F.lit(0)).cast("bigint").alias("_offset"))
                level = level.join(under, (F.col("known") == F.col("_known")) & (F.floor(F.col("node") / FAN).cast("bigint") == F.col("_above")))
                before, parent = F.col("_offset"), [F.col("_known"), F.col("_above")]
            left = Window.partitionBy(*parent).orderBy("known", "node").rowsBetween(Window.unboundedPreceding, -1)  # FAN rows at most
            offset = (before + F.coalesce(F.sum("length").over(left), F.lit(0))).alias(f"offset_{side}")
            sides.append(level.select("known", "node", offset, *(F.col(c).alias(f"{c}_{side}") for c in level.columns if c not in ("known", "node", "_known", "_above", "_offset"))))
        found = sides[0].join(sides[1], ["known", "node"], "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")) & F.lit(not same))
        last = path
        suspects, path = cut(found, "suspects")
        if last:
            drop(spark, last)
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    ends = [f"{c}_{side}" for side in "ab" for c in ("offset", "length", "records", "digest")]
    found = suspects.select(F.coalesce("page_id_a", "page_id_b").alias("page_id"), status.alias("status"), *ends)
    return found.withColumns({f"offset_{x}": F.when(F.col(f"length_{x}").isNotNull(), F.col(f"offset_{x}")) for x in "ab"})


def audited(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """:func:`audit` of two tables of records; only its result stays in the shared folder."""
    written = [cut(index(x), "merkle") for x in (ours, theirs)]
    depth = depth_of(*(leaves for leaves, _ in written))
    trees = [tree(leaves, depth) for leaves, _ in written]
    found = audit(*(levels for levels, _ in trees))
    for path in [p for _, p in written] + [p for _, paths in trees for p in paths]:
        drop(ours.sparkSession, path)
    return found


def damaged(pages: DataFrame) -> DataFrame:
    """A replica in which some pages have another first character and some are gone."""
    hurt = F.when(F.col("page_id") % 101 == 7, F.expr("concat('#', substring(html, 2))")).otherwise(F.col("html"))
    return pages.where("page_id is null or page_id % 9973 <> 77").withColumn("html", hurt)


def op6_warc(spark: SparkSession, sf_dir: str, replica: DataFrame | None = None) -> DataFrame:
    """``replica``: pages of the second copy; without it, a damaged one is made of the table."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audited(records(pages), records(damaged(pages) if replica is None else replica))


def _side(name: str, pages: str) -> str:
    text = "'WARC/1.0' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::varchar, '') || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') || e || e"
    return f"""{name} as (select *, (sum(length) over (order by page_id) - length)::bigint as "offset"
      from (select page_id, sum(strlen(r))::bigint as length, count(*) as records, min(sha256(r)) as digest, list_sort(list(sha256(r))) as digests
            from (select page_id, {text} as r from ({pages}), (select chr(13) || chr(10) as e)) group by page_id))"""


SQL = f"""
with {_side("a", "select page_id, url, html from pages")},
{_side("b", "select page_id, url, case when page_id % 101 = 7 then '#' || substring(html, 2) else html end as html from pages where page_id % 9973 <> 77")}
select coalesce(a.page_id, b.page_id) as page_id,
  case when b.digest is null then 'missing' when a.digest is null then 'extra' else 'changed' end as status,
  a."offset" as offset_a, a.length as length_a, a.records as records_a, a.digest as digest_a,
  b."offset" as offset_b, b.length as length_b, b.records as records_b, b.digest as digest_b
from a full join b on a.page_id = b.page_id
where a.digests is distinct from b.digests
"""
