"""URL filter: a blocked Bloom filter in front of an exact join, and host/path rules.

The filter of the listed canonical URLs is built by ``bit_or`` per block and sent to the
tasks; its size is bounded (see ``bloom``).  Rows that pass it are joined with the list
exactly, so the filter never decides by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm import bloom
from strandloom.llm.common import map_batches
from strandloom.staging import stage

@dataclass(frozen=True)
class Rule:
    """``host/path`` and whether it allows or blocks."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (
    Rule("com/", "allow"),
    Rule("example.com/en/", "block"),
    Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"),
    Rule("net/fr/", "block"),
)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a URL without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    there = at > 0
    return F.when(there, lower_ascii(host)).otherwise(""), F.when(there, path).otherwise("")


def canonical(host: Column, path: Column) -> Column:
    """The URL without scheme, ``www.``, query, fragment, ``.html`` and closing slashes.

    Null where there is no host.
    """
    short = F.regexp_replace(F.regexp_replace(path, r"\.html?\z", ""), r"/+\z", "")
    return F.when(host != "", F.concat(F.regexp_replace(host, r"\Awww\.", ""), short))


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Number of the longest rule that fits; of equal lengths a blocking one, then the first."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), rules[i].verdict != "block", i))
    out = F.lit(None).cast("int")
    for i in reversed(order):
        fits = ((host == rules[i].host) | host.endswith("." + rules[i].host)) & path.startswith(rules[i].path)
        out = F.when(fits, i).otherwise(out)
    return out


def listed_urls(df: DataFrame, listed: DataFrame, max_blocks: int = bloom.MAX_BLOCKS) -> DataFrame:
    """``df`` (with ``url``, any columns) plus ``_listed``: whether its url is in ``listed``.

    Null URLs are not listed; repeated entries of the list do no harm; nothing is dropped.
    """
    entries = stage(listed.select("url").where("url is not null").distinct(), "url-list")
    n = entries.count()
    hashed = entries.select(F.xxhash64("url").alias("hash"))
    sent = df.sparkSession.sparkContext.broadcast(bloom.build(hashed, "hash", n, max_blocks))
    columns = df.columns
    schema = df.withColumn("_maybe", F.lit(True)).schema

    def start():
        bloom_filter = sent.value

        def step(batch: pa.RecordBatch) -> dict:
            hashes = batch.column("_hash").to_numpy(zero_copy_only=False).astype(np.int64)
            there = batch.column("url").is_valid().to_numpy(zero_copy_only=False)
            return {c: batch.column(c) for c in columns} | {"_maybe": bloom_filter.passes(hashes) & there}

        return step

    marked = map_batches(df.withColumn("_hash", F.xxhash64("url")), schema, start)
    hits = entries.select(F.col("url").alias("_key"))
    # Rows the filter stops have a null key: they match nothing and are dealt by a salt.
    key = F.when(F.col("_maybe"), F.col("url"))
    stopped = marked.where(~F.col("_maybe")).withColumn("_listed", F.lit(False))
    passed = marked.where("_maybe").join(hits, key == F.col("_key"), "left").withColumn("_listed", F.col("_key").isNotNull())
    return stopped.select(*columns, "_listed").unionByName(passed.select(*columns, "_listed"))


def filter_pages(pages: DataFrame, blocked: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and whether the exact list holds the URL.

    The longest fitting rule decides; without one the list does.  Null URLs and URLs
    without ``://`` have empty host and path and are allowed; repeated rows are judged
    alike; empty tables give no rows or no listed URL.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("url", canonical(F.col("host"), F.col("path")))
    number = best_rule(F.col("host"), F.col("path"), rules)
    verdict, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, rule in enumerate(rules):
        verdict = F.when(F.col("_rule") == i, rule.verdict).otherwise(verdict)
        text = F.when(F.col("_rule") == i, rule.text).otherwise(text)
    found = listed_urls(rows.withColumn("_rule", number), blocked)
    return found.select(
        "page_id",
        "host",
        "path",
        text.alias("rule"),
        F.coalesce(verdict, F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"),
        F.col("_listed").alias("listed"),
    )


def repeated_urls(pages: DataFrame) -> DataFrame:
    """The canonical URLs under which more than one page was fetched."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(host.alias("host"), path.alias("path"))
    url = canonical(F.col("host"), F.col("path")).alias("url")
    return rows.select(url).where("url is not null").groupBy("url").count().where("count > 1").select("url")
