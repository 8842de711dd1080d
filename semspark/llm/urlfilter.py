"""URL filters that change over time: an as-of join of captures with dated list entries, in native Spark functions.

A list's log of additions and removals becomes validity intervals. A capture is looked up by its host, by each of its
parent domains and by each prefix of its path, among the entries that were active on the day it was fetched. The
most specific entry decides: a longer path prefix before a shorter one, a prefix before a host, a host before a
domain, a longer domain before a shorter one; of entries alike, a block before an allowance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, short, written

FOREVER = "9999-12-31"
#: Intervals, and decided urls, that are broadcast; their number is checked, and more are joined by shuffles.
BROADCAST_ROWS = 20_000
#: Parts that the lookups of one key and day are dealt out to when they are joined by a shuffle.
SALTS = 32


def intervals(entries: DataFrame) -> DataFrame:
    """(action, kind, value, valid_from, valid_to) of each run of days on which an entry is active.

    ``entries`` has action ('block' or 'allow'), kind ('host', 'domain' or 'prefix'), value, op ('add' or 'remove')
    and day. Of several ops on a day a removal is last; an addition to an active entry and a removal of an inactive
    one change nothing. Entries with a null in any of these columns are ignored. valid_to is exclusive.
    """
    log = entries.where("op in ('add', 'remove') and kind in ('host', 'domain', 'prefix') and action in ('block', 'allow') and value is not null and day is not null")
    log = log.groupBy("action", "kind", F.lower("value").alias("value"), F.col("day").cast("date").alias("day")).agg(F.max("op").alias("op"))
    w = Window.partitionBy("action", "kind", "value").orderBy("day")
    changes = log.withColumn("before", F.lag("op").over(w)).where("op <> coalesce(before, 'remove')")
    spans = changes.withColumn("valid_to", F.coalesce(F.lead("day").over(w), F.lit(FOREVER).cast("date"))).where("op = 'add'")
    return spans.select("action", "kind", "value", F.col("day").alias("valid_from"), "valid_to")


def _keys() -> str:
    """Array of (kind, value, rank) under which a url with the columns host and path is looked up."""
    labels = "split(host, '[.]')"
    domains = f"transform(sequence(1, size({labels})), i -> named_struct('kind', 'domain', 'value', array_join(slice({labels}, i, size({labels})), '.'), 'rank', 1000 - i))"
    parts = "filter(split(path, '/'), x -> x <> '')"
    prefixes = f"if(size({parts}) = 0, array(), transform(sequence(1, size({parts})), i -> named_struct('kind', 'prefix', 'value', concat(host, '/', lower(array_join(slice({parts}, 1, i), '/'))), 'rank', 100000 + i)))"
    return f"concat({domains}, array(named_struct('kind', 'host', 'value', host, 'rank', 10000)), {prefixes})"


def filter_urls(captures: DataFrame, entries: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``captures`` (with url and fetched) and for each row blocked, matched_action, matched_kind, matched_value and
    matched_from: the entry that decides, null if none was active.

    A null or malformed url or a null day matches nothing and is not blocked. Rows that repeat are judged alike. An
    empty table of captures gives no rows; without entries nothing is blocked. Columns of the matches' names in
    ``captures`` are replaced. Urls are made distinct by day before they are looked up. A short list of intervals is
    broadcast. A longer one is joined by a shuffle, first with the distinct keys and days, then, with each active entry
    copied to SALTS parts, with the urls; so the urls of one domain on one day are no single task.
    """
    names = [c for c in captures.columns if c.lower() not in ("blocked", "matched_action", "matched_kind", "matched_value", "matched_from")]
    url, day, hit = fresh(names, "uf_url", "uf_day", "uf_hit")
    asked = captures.select(F.col("url").cast("string").alias("url"), F.col("fetched").cast("date").alias("day")).where("url is not null and day is not null").distinct()
    split = asked.select(
        "url",
        "day",
        F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"),
        F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
    ).where("host <> ''")
    keys = split.select("url", "day", F.explode(F.expr(_keys())).alias("k")).select("url", "day", "k.*")
    spans = written(intervals(entries), "intervals")
    if spans.count() <= broadcast_rows:
        matched = keys.join(F.broadcast(spans), ["kind", "value"]).where("day >= valid_from and day < valid_to")
    else:
        lookups = keys.select("kind", "value", "day").distinct()
        active = lookups.join(spans, ["kind", "value"]).where("day >= valid_from and day < valid_to")
        active = active.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        matched = keys.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(active, ["kind", "value", "day", "salt"])
    best = F.max(F.struct("rank", (F.col("action") == "block").alias("block"), "action", "kind", "value", "valid_from")).alias(hit)
    decided = short(written(matched.groupBy("url", "day").agg(best).withColumnsRenamed({"url": url, "day": day}), "decided"), broadcast_rows)
    out = captures.select(*[F.col(f"`{c}`") for c in names]).join(decided, (F.col("url").cast("string") == F.col(url)) & (F.col("fetched").cast("date") == F.col(day)), "left")
    h = F.col(hit)
    return out.select(
        *[F.col(f"`{c}`") for c in names],
        F.coalesce(h["block"], F.lit(False)).alias("blocked"),
        h["action"].alias("matched_action"),
        h["kind"].alias("matched_kind"),
        h["value"].alias("matched_value"),
        h["valid_from"].alias("matched_from"),
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """The pages as captures: each is given a day of the year 2024 by its id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))


def entries_of_captures(captures: DataFrame) -> DataFrame:
    """A log of list entries about the hosts of ``captures``, drawn from the md5 of the values."""
    hosts = captures.select(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]*)", 1)).alias("host")).where("host <> ''").distinct()
    values = hosts.selectExpr(
        "explode(array(named_struct('action', 'block', 'kind', 'host', 'value', host), named_struct('action', 'allow', 'kind', 'prefix', 'value', concat(host, '/en')), named_struct('action', 'block', 'kind', 'domain', 'value', substring_index(host, '.', -2)))) as x"
    ).select("x.*").distinct()
    hashed = values.withColumn("h", F.md5(F.concat_ws(":", "action", "kind", "value")))
    number = lambda a: F.conv(F.substring("h", a, 3), 16, 10).cast("int")
    first = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(number(1), F.lit(200)).cast("int"))
    dated = hashed.where(F.substring("h", 12, 1) < "a").withColumn("first", first).withColumn("last", F.date_add("first", (F.pmod(number(4), F.lit(150)) + 1).cast("int")))
    again = F.date_add("last", (F.pmod(number(7), F.lit(60)) + 1).cast("int"))
    log = F.array(F.struct(F.lit("add").alias("op"), F.col("first").alias("day")), F.struct(F.lit("remove").alias("op"), F.col("last").alias("day")), F.struct(F.lit("add").alias("op"), again.alias("day")))
    return dated.select("action", "kind", "value", F.explode(log).alias("x")).select("action", "kind", "value", "x.op", "x.day")
