"""URL filtering: rules for hosts and paths, then a list of canonical URLs behind a blocked Bloom filter.

A rule fits its host and all its subdomains where the URL's path starts with the rule's; of the rules that fit the longest
decides. URLs without a rule go to the list: a Bloom filter of 256-bit blocks, built from the list in Spark (a block for
each group of hashes, its bits in four longs), lets few unlisted URLs through, and an exact hash join of what passes with the
list removes those. The filter is broadcast only when it was counted to have few blocks; beyond that its blocks are joined by
their number. Both lookups run over distinct canonical URLs, so a URL that half of the pages share is looked up once.

Everything is DataFrame functions. Defined results: a null url, or one without ``://``, has an empty host and path, fits no
rule and is on no list; other columns are ignored; repeated rows are repeated in the result; an empty list lists nothing; a
very long url is judged whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_or_plain

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits in a block, bits set for each URL, and bits of filter for each listed URL.
BLOCK_BITS, SET_BITS, BITS_PER_URL = 256, 6, 16
#: Blocks (of 4 longs) that may be broadcast: 32 MB.
BROADCAST_BLOCKS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """``host/path`` with what it decides. More rules than a few hundred belong into the list."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: list[Rule], what: str) -> Column:
    """The text or the verdict of the longest rule that fits; null without one."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.lit(getattr(r, what))).otherwise(found)
    return found


def canonical(host: Column, path: Column) -> Column:
    """Host and path without slashes at the end; empty without a host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(host, F.regexp_replace(path, "/+$", "")))


def _places(url: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """The block of a URL, and its bits' places within the block."""
    bits = F.xxhash64(url, F.lit("bits"))
    return F.pmod(F.xxhash64(url), F.lit(n_blocks)), [F.shiftrightunsigned(bits, 8 * i).bitwiseAND(BLOCK_BITS - 1).cast("int") for i in range(SET_BITS)]


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """listed (canonical) -> block, w0 to w3: the filter's blocks that have a bit set."""
    block, places = _places(F.col("canonical"), n_blocks)
    words = [_or([F.when(F.shiftright(p, 6) == w, _bit(p)).otherwise(F.lit(0).cast("long")) for p in places]) for w in range(BLOCK_BITS // 64)]
    return listed.select(block.alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(words))).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_BITS // 64)))


def _bit(place: Column) -> Column:
    """A long with one bit set, at the place modulo 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63))


def _or(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseOR(c)
    return out


def passes(urls: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The rows of urls (canonical) whose bits are all set in the filter."""
    block, places = _places(F.col("canonical"), n_blocks)
    joined = urls.withColumn("block", block).join(small_or_plain(blocks, BROADCAST_BLOCKS), "block")
    word = [F.element_at(F.array("w0", "w1", "w2", "w3"), F.shiftright(p, 6) + 1) for p in places]
    hit = F.lit(True)
    for p, w in zip(places, word, strict=True):
        hit = hit & (w.bitwiseAND(_bit(p)) != 0)
    return joined.where(hit).select("canonical")


def on_list(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """The distinct canonical URLs of urls that are listed."""
    listed = cut(listed.select("canonical").where("canonical <> ''").distinct())
    n_blocks = max(1, listed.count() * BITS_PER_URL // BLOCK_BITS)
    blocks = cut(bloom_blocks(listed, n_blocks))
    possible = passes(urls.select("canonical").where("canonical <> ''").distinct(), blocks, n_blocks)
    return possible.join(listed, "canonical", "left_semi")


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, listed_verdict: str = "block", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict and canonical. listed has a column canonical."""
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    rows = rows.select("*", rule_column(host, path, rules, "text").alias("rule"), rule_column(host, path, rules, "verdict").alias("by_rule"), canonical(host, path).alias("canonical"))
    found = cut(on_list(rows.where("by_rule is null"), listed)).withColumn("listed", F.lit(True))
    by_list = F.when(F.col("listed"), F.lit(listed_verdict)).otherwise(F.lit(default))
    # Only rows that ask the list are joined: rows with a rule or without a host share no key.
    asks = F.col("by_rule").isNull() & (F.col("canonical") != "")
    looked_up = rows.where(asks).join(small_or_plain(found), "canonical", "left").withColumn("verdict", by_list)
    decided = rows.where(~asks).withColumn("verdict", F.coalesce("by_rule", F.lit(default)))
    names = ["page_id", "host", "path", "rule", "verdict", "canonical"]
    return decided.select(*names).unionByName(looked_up.select(*names))


def urls_of_hosts(pages: DataFrame, labels: list[str]) -> DataFrame:
    """A list for crawls: the canonical URLs of pages whose host has one of the labels (between its dots)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return pages.where(F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, labels)))).select(canonical(host, path).alias("canonical")).distinct()
