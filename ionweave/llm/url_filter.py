"""URL verdicts: host and path rules, then a list behind a blocked Bloom filter.

Listed URLs are compared in canonical form. A blocked Bloom filter of them has a 256-bit block
for each few of them, up to a bound, so that it can be broadcast whatever the length of the
list: one hash picks the block, another sets eight bits in it, two in each 64-bit word. Pages that the filter
passes, and only those, go to an exact hash join with the list, which removes false positives: both
are shuffled by URL, the list is the side that is hashed, and hot URLs of pages are split at run time.
Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Query parameters that don't change what a URL shows.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
#: Listed URLs for each block of 256 bits, and the most blocks: 262,144 rows of five numbers, 10 MiB. A longer list fills them more; the join decides all the same.
EACH, MOST_BLOCKS = 16, 1 << 18


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without slashes at its end, and the query's
    parameters in order without those for tracking; neither scheme nor fragment."""
    name = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)://[^?#]*\?([^#]*)", 1), F.lit(""))
    asked = F.filter(F.array_sort(F.split(query, "&")), lambda p: (p != "") & ~p.rlike(TRACKING))
    tail = F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise("")
    return F.concat(name, F.regexp_replace(path(url), r"/+$", ""), tail)


def rule_of(host_: Column, path_: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, as a struct; null if none does."""
    fits = [
        F.when(
            ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(p),
            F.struct(F.lit(f"{h}{p}").alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))
    ]
    return F.coalesce(*fits)


def _bits(url: Column, n_blocks: int) -> list[Column]:
    """The block of a canonical URL and its four words of bits."""
    block = F.pmod(F.xxhash64(url), F.lit(n_blocks)).cast("int").alias("block")
    second = F.xxhash64(url, F.lit("bits"))
    words = []
    for i in range(4):
        a, b = (F.pmod(F.shiftrightunsigned(second, 12 * i + 6 * j), F.lit(64)).cast("int") for j in (0, 1))
        one = F.lit(1).cast("long")
        words.append(F.call_function("shiftleft", one, a).bitwiseOR(F.call_function("shiftleft", one, b)).alias(f"w{i}"))
    return [block, *words]


def block_count(listed: DataFrame) -> int:
    """How many blocks a list gets: a power of two, 1,024 at least."""
    return min(MOST_BLOCKS, 1 << max(10, (listed.count() // EACH).bit_length()))


def bloom_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """The filter of ``listed`` (column ``url``, canonical): at most ``n_blocks`` rows."""
    return (
        listed.select(*_bits(F.col("url"), n_blocks)).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"f{i}") for i in range(4)))
    )


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, n_blocks: int | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` for every page (``page_id, url``).

    ``listed`` has a column ``url`` of URLs in any spelling; nulls in it are passed over. A page
    whose url is null or has no ``://`` has an empty host and path, fits no rule, is not listed
    and is allowed. Repeated rows give repeated rows, other columns are ignored, and an empty
    table of either kind is fine. ``n_blocks`` is the filter's size; else the list is counted.
    """
    known = listed.where(F.col("url").contains("://")).select(canonical(F.col("url")).alias("url")).distinct()
    known = cut(known)  # it is counted, makes the filter and is joined
    n_blocks = n_blocks or block_count(known)
    seen = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "url")
    fit = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.withColumn("fit", fit).withColumn(
        "asked", F.when(F.col("fit").isNull() & F.col("url").contains("://"), canonical(F.col("url")))
    )
    hashed = seen.select("*", *_bits(F.col("asked"), n_blocks))
    filter_ = F.broadcast(bloom_filter(known, n_blocks))  # n_blocks rows at most
    passes = F.lit(True)
    for i in range(4):
        passes = passes & (F.col(f"f{i}").bitwiseAND(F.col(f"w{i}")) == F.col(f"w{i}"))
    tried = hashed.join(filter_, "block", "left").withColumn(
        "possible", F.coalesce(passes & F.col("asked").isNotNull(), F.lit(False))
    )
    columns = ["page_id", "host", "path", F.col("fit.rule").alias("rule")]
    clear = tried.where(~F.col("possible")).select(
        *columns, F.coalesce("fit.verdict", F.lit("allow")).alias("verdict"), F.lit(False).alias("listed")
    )
    exact = known.select(F.col("url").alias("listed_url"))
    hit = F.col("listed_url").isNotNull()
    doubtful = (
        tried.where("possible")
        .join(exact.hint("shuffle_hash"), F.col("asked") == F.col("listed_url"), "left")
        .select(*columns, F.when(hit, "block").otherwise("allow").alias("verdict"), hit.alias("listed"))
    )
    return clear.unionByName(doubtful)
