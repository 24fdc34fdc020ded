"""URL filters: dated list entries become intervals, captures meet those active at fetch time.

An entry adds a pattern to a list or removes it, from a date on. A pattern is a domain (it
covers its subdomains), a host, or a host with the start of a path, cut at segments. A
capture is blocked if a block entry is active when it was fetched and no allow entry is.

Entries without list, scope, pattern, date or action are void. If a pattern is added and
removed on one day, the removal counts. Captures without URL or fetch date match nothing and
are kept. Repeated captures get one row each; empty tables give all captures unblocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standtally.sources.staging import broadcast_if_small, stage

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Host in lower case; empty if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def patterns_of(url: Column) -> Column:
    """Every (scope, pattern) that could cover the URL: as many as it has labels and segments."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(
            F.lit("domain").alias("scope"),
            F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern"),
        ),
    )
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    prefixes = F.transform(
        F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments))).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: F.struct(
            F.lit("prefix").alias("scope"),
            F.concat_ws("/", host, F.array_join(F.slice(segments, F.lit(1), i), "/")).alias("pattern"),
        ),
    )
    exact = F.array(F.struct(F.lit("host").alias("scope"), host.alias("pattern")))
    return F.when(host != "", F.array_distinct(F.concat(domains, exact, prefixes)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, scope, pattern, valid_from, valid_to): from an addition to the next removal.

    ``entries``: list, scope, pattern, dated, action ('add' or 'remove'). First one row per
    pattern and day, so that the window over a pattern holds at most as many rows as there
    are days. ``valid_to`` is exclusive, and missing while the entry stands.
    """
    keys = ["list", "scope", "pattern"]
    daily = (
        entries.select(*keys, "dated", "action")
        .dropna()
        .groupBy(*keys, "dated")
        .agg(F.max((F.col("action") == "remove").cast("int")).alias("removed"))
    )
    by_day = Window.partitionBy(*keys).orderBy("dated")
    changes = daily.withColumn("_last", F.lag("removed").over(by_day)).filter(
        F.coalesce(F.col("_last"), F.lit(1)) != F.col("removed")
    )
    return (
        changes.withColumn("valid_to", F.lead("dated").over(by_day))
        .filter("removed = 0")
        .select(*keys, F.col("dated").alias("valid_from"), "valid_to")
    )


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (url, fetched_on, any others) with n_block, n_allow, first_pattern, blocked.

    Distinct pairs of URL and date are evaluated once. They meet the intervals on the exact
    pattern, so a capture is compared with the few dates of its own patterns. The intervals
    are staged; if they are few they are broadcast, else a shuffled join splits hot hosts.
    """
    intervals = broadcast_if_small(stage(validity_intervals(entries), "url-intervals"))
    asked = captures.select(
        F.col("url").alias("_url"), F.col("fetched_on").alias("_on")
    ).dropna().distinct()
    looked_up = asked.select("_url", "_on", F.explode(patterns_of(F.col("_url"))).alias("_p")).select(
        "_url", "_on", F.col("_p.scope").alias("scope"), F.col("_p.pattern").alias("pattern")
    )
    active = looked_up.join(intervals, ["scope", "pattern"]).filter(
        (F.col("valid_from") <= F.col("_on"))
        & (F.col("valid_to").isNull() | (F.col("_on") < F.col("valid_to")))
    )
    allows = F.col("list") == "allow"
    verdicts = active.groupBy("_url", "_on").agg(
        F.count_if(~allows).alias("_block"),
        F.count_if(allows).alias("_allow"),
        F.min(F.when(~allows, F.concat_ws(":", "scope", "pattern"))).alias("_first"),
    )
    joined = captures.join(
        verdicts,
        (F.col("url") == F.col("_url")) & (F.col("fetched_on") == F.col("_on")),
        "left",
    )
    own = ("n_block", "n_allow", "first_pattern", "blocked")
    n_block, n_allow = (F.coalesce(F.col(c), F.lit(0)) for c in ("_block", "_allow"))
    return joined.select(
        *[captures[c] for c in captures.columns if c not in own],
        n_block.alias("n_block"),
        n_allow.alias("n_allow"),
        F.col("_first").alias("first_pattern"),
        ((n_block > 0) & (n_allow == 0)).alias("blocked"),
    )


def dated_captures(pages: DataFrame) -> DataFrame:
    """Captures of the test tables: a fetch date in 2024 for every page, from its number."""
    return pages.select(
        "page_id",
        "url",
        F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("page_id") * 37) % 365).cast("int")).alias(
            "fetched_on"
        ),
    )


def dated_entries(pages: DataFrame) -> DataFrame:
    """Lists for the test tables, drawn from all their hosts and first path segments.

    A host's lowest page number decides what becomes of it: domains are blocked, unblocked
    and partly blocked anew, hosts are blocked for good or allowed for a while, and first
    path segments are blocked for 90 days.
    """
    seen = pages.select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        F.get(F.filter(F.split(F.regexp_extract("url", PATH, 1), "/"), lambda s: s != ""), F.lit(0)).alias(
            "segment"
        ),
    ).filter("host <> ''")
    hosts = seen.groupBy("host").agg(F.min("page_id").alias("m"))
    starts = (
        seen.filter("segment is not null").groupBy("host", "segment").agg(F.min("page_id").alias("m"))
    )
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    path = F.concat_ws("/", "host", "segment")

    def event(keep: str, name: str, scope: str, pattern: Column, day: str, action: str) -> Column:
        return F.when(
            F.expr(keep),
            F.struct(
                F.lit(name).alias("list"),
                F.lit(scope).alias("scope"),
                pattern.alias("pattern"),
                F.date_add(F.lit("2024-01-01").cast("date"), F.expr(f"cast({day} as int)")).alias("dated"),
                F.lit(action).alias("action"),
            ),
        )

    def listed(source: DataFrame, *events: Column) -> DataFrame:
        return source.select(F.inline(F.filter(F.array(*events), lambda e: e.isNotNull())))

    return listed(
        hosts,
        event("m % 3 = 0", "block", "domain", domain, "m * 11 % 200", "add"),
        event("m % 3 = 0", "block", "domain", domain, "m * 11 % 200 + 60", "remove"),
        event("m % 6 = 0", "block", "domain", domain, "m * 11 % 200 + 120", "add"),
        event("m % 5 = 1", "block", "host", F.col("host"), "m * 7 % 300", "add"),
        event("m % 7 = 2", "allow", "host", F.col("host"), "m * 13 % 300", "add"),
        event("m % 7 = 2", "allow", "host", F.col("host"), "m * 13 % 300 + 45", "remove"),
    ).unionByName(
        listed(
            starts,
            event("m % 4 = 0", "block", "prefix", path, "m * 17 % 250", "add"),
            event("m % 4 = 0", "block", "prefix", path, "m * 17 % 250 + 90", "remove"),
        )
    )
