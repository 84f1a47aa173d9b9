"""URL rules indexed by their rarest literal token (DataFrame functions only).

A rule is a host and a path prefix.  The rule's literal tokens (host labels
and whole path segments) are counted over all URLs; the rule is filed under
the rarest of them.  A URL's tokens fetch the rules filed under them, and the
regular expressions of those rules alone are run.

Defined results: a URL that is null or has no ``://`` has empty host and
path, fits no rule and gets the default verdict; among fitting rules the
longest (host and path together) wins, then the longer host, then ``block``,
then the smaller text; repeated rows are judged one by one; other columns of
the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Index tokens whose rules one literal map holds; more are fetched map by map.
MAP_TOKENS = 5_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        """Over host and path with a # between them (neither can hold one)."""
        return rf"^(?:[^#]*\.)?{_quoted(self.host)}#{_quoted(self.path)}"

    def tokens(self) -> list[str]:
        """Tokens that every URL the rule fits has: host labels, path segments closed by a slash."""
        closed = self.path.split("/")[1:-1]
        return [f"h:{x}" for x in self.host.split(".") if x] + [f"p:{x}" for x in closed if x]


def _quoted(literal: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/])", r"\\\1", literal)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    known = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    host = F.translate(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments))


def rarest_tokens(urls: DataFrame, rules: Sequence[Rule]) -> dict[str, list[int]]:
    """token -> rules filed under it.  The counts cover all URLs; at most one row for each rule token is collected."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    counts = dict.fromkeys(wanted, 0)
    if wanted:
        found = (
            urls.select(F.explode(F.array_intersect("__tokens", F.array(*map(F.lit, wanted)))).alias("t"))
            .groupBy("t").count().collect()
        )
        counts |= {row["t"]: row["count"] for row in found}
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        own = rule.tokens()
        if not own:
            raise ValueError(f"rule {rule.text!r} has no literal token to be filed under")
        index.setdefault(min(own, key=lambda t: (counts[t], t)), []).append(i)
    return index


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], default: str = "allow", key: str = "page_id", url: str = "url",
) -> DataFrame:
    """One row for each input row: key, host, path, rule (null if none fits), verdict."""
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("__tokens", url_tokens(F.col("host"), F.col("path")))
    index = rarest_tokens(rows, rules)

    def entry(r: Rule) -> Column:
        return F.struct(
            F.lit(len(r.text)).alias("length"), F.lit(len(r.host)).alias("host_length"),
            F.lit(int(r.verdict == "block")).alias("strict"), F.lit(r.text).alias("text"),
            F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"),
        )

    if not index:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    filed = sorted(index.items())
    target = F.concat_ws("#", "host", "path")

    def best_of(part: list[tuple[str, list[int]]]) -> Column:
        filed_under = F.create_map(*[x for token, own in part for x in (F.lit(token), F.array(*[entry(rules[i]) for i in own]))])
        keys = F.array(*[F.lit(token) for token, _ in part])
        fetched = F.flatten(F.transform(F.array_intersect(F.col("__tokens"), keys), lambda t: F.element_at(filed_under, t)))
        return F.array_max(F.filter(fetched, lambda r: F.rlike(target, r["regex"])))

    best = [best_of(filed[at : at + MAP_TOKENS]) for at in range(0, len(filed), MAP_TOKENS)]
    winner = best[0] if len(best) == 1 else F.array_max(F.filter(F.array(*best), lambda r: r.isNotNull()))
    return rows.withColumn("__best", winner).select(
        "page_id", "host", "path", F.col("__best.text").alias("rule"),
        F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"),
    )
