"""URLs judged by rules and by a list: a blocked Bloom filter first, then an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import UPPER, table

#: (host, path, verdict); fixed values of the query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Hosts whose pages make up the list of the query.
LISTED_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com", "spam-farm.example.net", "cheap-pills.example.net")
#: Blocks of the filter, 64 bits each: its size is fixed, whatever the list. A larger list only lets more rows reach the join.
BLOCKS = 1 << 16
#: Bits that an entry sets in its block.
BITS = 4


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The form in which URLs are listed; null without ``://``.

    Scheme, ``www.``, default ports, fragment, tracking parameters and a last slash go; other parameters are sorted.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref)(=|$)")))
    return F.when(url.contains("://"), F.concat(
        host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    ))


def first_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does; of equally long ones that with the longer host."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own_host, own_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(own_path)
        name = F.when(fits, F.lit(own_host + own_path)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: str) -> Column:
    """The bits of an entry: six bits each of a second hash."""
    h = F.xxhash64(key, F.lit(7))
    mask = F.lit(0).cast("bigint")
    for k in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")))
    return mask


def bloom_filter(listed: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """``(block, bits)``, ``blocks`` rows at most; bits of a block's entries are merged before they move."""
    return listed.groupBy(_block(key, blocks).alias("block")).agg(F.bit_or(_mask(key)).alias("bits"))


def on_list(rows: DataFrame, listed: DataFrame, key: str, flag: str, blocks: int = BLOCKS) -> DataFrame:
    """``rows`` with a boolean ``flag``: is ``key`` among those of ``listed``?

    Rows that the filter rules out stay where they are. The others are joined with
    the distinct listed keys, which removes false positives; a key that very many
    rows share is a skewed join, which adaptive execution splits. A null key is
    not on any list.
    """
    listed = listed.select(key).where(F.col(key).isNotNull()).distinct()
    bits = F.broadcast(bloom_filter(listed, key, blocks))  # blocks rows at most
    tried = rows.withColumn("block", _block(key, blocks)).join(bits, "block", "left").drop("block")
    mask = _mask(key)
    possible = F.col(key).isNotNull() & F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False))
    ruled_out = tried.where(~possible).drop("bits").withColumn(flag, F.lit(False))
    hits = tried.where(possible).drop("bits").join(listed.withColumn(flag, F.lit(True)), key, "left")
    return ruled_out.unionByName(hits.withColumn(flag, F.coalesce(flag, F.lit(False))))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages``.

    The longest fitting rule decides; without one a URL is blocked if its canonical
    form is among the ``url`` of ``listed``, else allowed. A null URL, or one
    without ``://``, has empty host and path, fits no rule and is on no list.
    Repeated rows stay; other columns are ignored; an empty table gives an empty
    result, an empty list blocks nothing.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        canonical(F.col("url")).alias("canonical"),
    )
    flagged = on_list(rows, listed.select(canonical(F.col("url")).alias("canonical")), "canonical", "listed")
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return flagged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))


def listed_pages(pages: DataFrame, hosts: tuple[str, ...] = LISTED_HOSTS) -> DataFrame:
    """The URLs of the pages that lie on listed hosts or their subdomains."""
    host = host_of(F.col("url"))
    on = F.lit(False)
    for name in hosts:
        on = on | (host == name) | host.endswith(f".{name}")
    return pages.select("url").where(on)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, listed_pages(pages))


_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{says}}}{h}{p}'"
    for h, p, says in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
)
_LISTED = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in LISTED_HOSTS)
ORACLE = f"""
WITH p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
           '{UPPER}', '{UPPER.lower()}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))) AS q
  FROM pages
), c AS (
  SELECT *, CASE WHEN contains(url, '://') THEN
           regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
           || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical,
         CASE {_FITS} END AS fit
  FROM p
), listed AS (SELECT DISTINCT canonical FROM c WHERE ({_LISTED}) AND canonical IS NOT NULL)
SELECT page_id, host, path, regexp_replace(fit, '^[{{][a-z]+[}}]', '') AS rule,
       coalesce(regexp_extract(fit, '^[{{]([a-z]+)[}}]', 1),
                CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM c
"""
