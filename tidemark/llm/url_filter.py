"""URL rules, and a list of URLs behind a blocked Bloom filter."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.shared import stage

#: (verdict, host, path): for the host and its subdomains, and paths that begin so.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Words of a Bloom block, bits of a word, and bits spent on a listed URL.
WORDS, WORD_BITS, BITS_PER_URL = 8, 64, 16
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def _lower(text: Column) -> Column:
    """A to Z in lower case, nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for the addresses of a page; null if the URL has no host.

    Scheme, query, fragment, a leading `www.` or `m.`, an ending `.html` and
    slashes at the end don't count.
    """
    name = F.regexp_replace(host(url), r"^(www|m)\.", "")
    place = F.regexp_replace(F.regexp_replace(path(url), "/+$", ""), r"\.html$", "")
    return F.when(name != "", F.concat(name, place))


def _fits(url_host: Column, url_path: Column, rule_host: str, rule_path: str) -> Column:
    inside = (url_host == rule_host) | url_host.endswith("." + rule_host)
    return inside & url_path.startswith(rule_path)


def rule_for(url_host: Column, url_path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = _fits(url_host, url_path, rule_host, rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _masks(url: str) -> list[Column]:
    """For each word of the block, the bit of the URL."""
    bits = F.xxhash64(F.col(url), F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftrightunsigned(bits, 6 * i) % WORD_BITS + WORD_BITS).cast("int") % WORD_BITS) for i in range(WORDS)]


def _block(url: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(url), F.lit("block")), F.lit(blocks))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, w0 .. w7): the filter, a row for each block that isn't empty."""
    masks = [m.alias(f"w{i}") for i, m in enumerate(_masks("listed"))]
    rows = listed.select(_block("listed", blocks).alias("block"), *masks)
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def listed_among(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """The URLs of `urls` (column url) that are in `listed` (column listed), each once.

    The filter has 16 bits for each listed URL and passes all listed ones and
    few others; a hash join with the list removes the others. Nothing is
    broadcast by hand: both tables are written first, so Spark knows their size.
    """
    listed = stage(listed.where(F.col("listed").isNotNull()).distinct(), "listed")
    blocks = max(1, -(-listed.count() * BITS_PER_URL // (WORDS * WORD_BITS)))
    bloom = stage(bloom_filter(listed, blocks), "bloom")
    once = urls.select("url").where(F.col("url").isNotNull()).distinct()
    masks = _masks("url")
    passes = F.lit(True)
    for i, mask in enumerate(masks):
        passes &= F.col(f"w{i}").bitwiseAND(mask) == mask
    possible = (
        once.withColumn("block", _block("url", blocks)).join(bloom, "block").where(passes).select("url")
    )
    return possible.join(listed, possible["url"] == listed["listed"], "left_semi")


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """Allow or block each page by its URL.

    `pages` has page_id and url, `listed` has a column listed with canonical
    URLs to block. A rule decides where one fits; else a page is blocked if its
    canonical URL is listed. Returns a row per row of pages: page_id, host, path,
    rule, verdict. A null URL, or one without `://`, has an empty host and path
    and is allowed. An empty list blocks nothing.
    """
    url = F.col("url").cast("string")
    rows = pages.select(
        "page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical")
    )
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"))
    # A page that a rule decides needs no look at the list.
    hits = listed_among(rows.where(F.col("ruled").isNull()).select(F.col("canonical").alias("url")), listed)
    hits = hits.withColumnRenamed("url", "hit")
    return rows.join(hits, rows["canonical"] == hits["hit"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("hit").isNotNull(), "block").otherwise("allow")).alias("verdict"),
    )


def listed_sites(pages: DataFrame, sites: tuple[str, ...]) -> DataFrame:
    """Canonical URLs of the pages on the given sites, as a list (column listed).

    A site is one label of the host.
    """
    url = F.col("url").cast("string")
    on_site = F.arrays_overlap(F.split(host(url), r"\."), F.array(*map(F.lit, sites)))
    return pages.where(on_site).select(canonical(url).alias("listed"))
