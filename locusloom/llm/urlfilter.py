"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

Listed entries are canonical prefixes, host and path (`example.net/en/`): an entry covers its host, all
subdomains, and all paths that start with its own. A url has few canonical forms that could be listed: each
end of its host at a dot, with the path's beginnings of the lengths that listed paths have. The forms of
distinct urls are looked up in the filter; what it passes is joined with the entries, which removes false
positives. Rules decide by the longest entry; where no rule fits, a url is blocked if it is listed.

The filter has 512-bit blocks, one bit in each of eight 64-bit words, about 16 bits an entry and at
most MAX_BLOCKS blocks (8 MB), so it may be broadcast. All of it is DataFrame functions.

Defined results: a null url, or one without `://`, has empty host and path, fits no entry and is
allowed; rows that repeat are all returned; no entries allow everything; other columns
pass through, but those that the result names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the query: rules and listed hosts.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
LISTED = tuple(f"{name}.example.{top}/" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))

MAX_BLOCKS, BITS_PER_ENTRY = 1 << 17, 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(rows: DataFrame, url_col: str) -> DataFrame:
    """rows with host and path."""
    rest = F.expr(f"CASE WHEN instr(`{url_col}`, '://') > 0 THEN substring(`{url_col}`, instr(`{url_col}`, '://') + 3) ELSE '' END")
    return rows.withColumns({"host": F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def forms(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """(host, path, form): what of each url could be listed."""
    ends = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    starts = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    return urls.where("host <> ''").select("host", "path", F.explode(ends).alias("_end"), starts.alias("_starts")).select("host", "path", "_end", F.explode("_starts").alias("_start")).where("_start IS NOT NULL").select("host", "path", F.concat("_end", "_start").alias("form"))


def _placed(rows: DataFrame, blocks: int) -> DataFrame:
    """rows with the block of their form and the bit in each of its words."""
    bits = {f"b{i}": F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64('bits', form), {6 * i}) & 63 AS int))") for i in range(8)}
    return rows.withColumns({"block": F.pmod(F.xxhash64("form"), F.lit(blocks))} | bits)


def bloom(entries: DataFrame) -> tuple[DataFrame, int]:
    """The filter's blocks that aren't empty, and how many there are."""
    n = entries.count()
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * 512 < n * BITS_PER_ENTRY:
        blocks *= 2
    return _placed(entries.select("form"), blocks).groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(8)]), blocks


def judged(rows: DataFrame, entries: DataFrame, *, url_col: str = "url") -> DataFrame:
    """rows with host, path, rule (the longest that fits, or null), listed (a listed entry covers it) and
    verdict. entries: form, kind ('rule' or 'listed'), verdict."""
    found = parsed(rows.drop("host", "path", "rule", "listed", "verdict"), url_col)
    ruled = common.fresh(found, "_verdict")
    lengths = sorted(r[0] for r in entries.select(F.length(F.regexp_extract("form", "^[^/]*(.*)$", 1))).distinct().collect())  # no more than a path's length
    words, blocks = bloom(entries)
    looked = _placed(forms(found.select("host", "path").distinct(), lengths), blocks).join(F.broadcast(words), "block")
    possible = looked.where(" AND ".join(f"(w{i} & b{i}) = b{i}" for i in range(8))).select("host", "path", "form")
    exact = possible.join(entries, "form")
    best = exact.groupBy("host", "path").agg(
        F.max_by("form", F.when(F.col("kind") == "rule", F.length("form"))).alias("rule"), F.max_by("verdict", F.when(F.col("kind") == "rule", F.length("form"))).alias(ruled), F.max(F.col("kind") == "listed").alias("listed")
    )
    out = found.join(best, ["host", "path"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return out.withColumn("verdict", F.coalesce(ruled, F.when(F.col("listed"), "block").otherwise("allow"))).drop(ruled)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame([(f, "rule", v) for f, v in RULES.items()] + [(f, "listed", "block") for f in LISTED], "form string, kind string, verdict string")
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, entries).select("page_id", "host", "path", "rule", "verdict")


_HOST = "translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = "('.' || host) LIKE '%.{0}' AND starts_with(path, '{1}')"


def _case(entries: dict[str, str]) -> str:
    longest = sorted(entries, key=lambda e: (-len(e), e))
    return " ".join("WHEN " + _FITS.format(*_split(e)) + f" THEN '{entries[e]}'" for e in longest)


def _split(entry: str) -> tuple[str, str]:
    host, _, path = entry.partition("/")
    return host, "/" + path


ORACLE = f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {_case({e: e for e in RULES})} END AS rule,
  CASE {_case(RULES)} {_case(dict.fromkeys(LISTED, "block"))} ELSE 'allow' END AS verdict
FROM u
"""
