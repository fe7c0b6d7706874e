"""URL filters by a temporal list join, in DataFrame functions only.

Dated list entries (a key is added or removed on a day) become validity
intervals.  Every capture is expanded to the keys under which a list may name
it: its URL, its host and each parent domain, and its host with each
leading path.  An as-of join finds the entries in force on the day of the fetch.

List keys and captures are brought to one form first: lower-case scheme and host, no
default port, no user, no fragment, no slash at a path's end.  A capture is expanded only to
the depths that the list has, so a URL of many segments costs no more than another one.

The intervals are broadcast if their keys take few bytes; a longer list
is joined by key, with the captures' keys salted and the list repeated for each
salt, so a host with a third of all captures is spread.  Both plans give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.llm._store import cut

BROADCAST_BYTES = 16 << 20
SALTS = 16
#: Scheme, user, host (names, or addresses in brackets), port, path and query of a URL; and ports by scheme.
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?"
PORTS = {"http": "80", "https": "443"}


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL, 2))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, URL, 4)


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, F.lit("/")), lambda p: p != "")


def plain_url(url: Column) -> Column:
    """One form of a URL: lower-case scheme and host, no user, default port or fragment, ``/`` for an empty path; others stay."""
    scheme, port, path = F.lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 3), path_of(url)
    usual = (port == "") | F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PORTS.items() for x in kv)), scheme) == port, F.lit(False))
    out = F.concat(scheme, F.lit("://"), host_of(url), F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.regexp_extract(url, URL, 5))
    return F.when(host_of(url) == "", url).otherwise(out)


def plain_key(kind: Column, key: Column) -> Column:
    """A list's key in the form of the captures' keys; a domain or path may be given as a URL, or with its default port."""
    bare = F.regexp_replace(F.regexp_replace(key, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?", ""), r"[?#].*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^(\[[^\]]*\]|[^/:]*)", 1)), r"^\.+|\.+$", "")
    parts = _segments(F.regexp_replace(bare, r"^(\[[^\]]*\]|[^/:]*)(:[0-9]*)?", ""))
    path = F.concat_ws("/", F.concat(F.array(host), parts))
    return F.when(kind == "url", plain_url(key)).when(kind == "domain", host).when(kind == "path", path).otherwise(key)


def keys_of(url: Column, labels: Column, depths: Column) -> Column:
    """Array of (kind, key): 'url', 'domain' (host and parents of these numbers of labels) and 'path' (host with so many leading segments)."""
    host, parts = host_of(url), _segments(path_of(url))
    names = F.when(host.startswith("["), F.array(host)).otherwise(F.split(host, F.lit("\\.")))
    domains = F.transform(F.filter(labels, lambda n: n <= F.size(names)), lambda n: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(names, F.size(names) - n + 1, n), ".").alias("key")))
    lead = F.transform(F.filter(depths, lambda n: n <= F.size(parts)), lambda n: F.struct(F.lit("path").alias("kind"), F.array_join(F.concat(F.array(host), F.slice(parts, 1, n)), "/").alias("key")))
    none = F.array().cast("array<struct<kind:string,key:string>>")
    whole = F.array(F.struct(F.lit("url").alias("kind"), plain_url(url).alias("key")))
    return F.when(host == "", none).otherwise(F.concat(whole, domains, lead))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, key, since, until) from dated entries (list, kind, key, day, action).

    ``until`` is null while an entry is in force.  Of one day's entries for a key
    an addition outweighs a removal.  Entries with a null key, kind or day, or with
    another action than 'add' and 'remove', are ignored; repeated entries, and entries whose keys are the
    same in their plain form, count once.
    """
    e = entries.filter("key is not null and kind is not null and day is not null and action in ('add', 'remove')")
    e = e.withColumn("key", plain_key(F.col("kind"), F.col("key"))).filter("key <> ''")
    e = e.groupBy(F.coalesce("list", F.lit("")).alias("list"), "kind", "key", F.to_date("day").alias("day")).agg(F.max(F.col("action") == "add").alias("on"))
    w = Window.partitionBy("list", "kind", "key").orderBy("day")
    e = e.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).filter("on <> was")
    return e.withColumn("until", F.lead("day").over(w)).filter("on").select("list", "kind", "key", F.col("day").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", fetched: Column | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Return (id, url, fetched, n_entries, lists, blocked) for each distinct capture.

    ``lists`` names the lists that hold it on that day, sorted and joined by
    commas.  A null URL, a URL without a host and a null day match nothing and
    pass.  Captures that repeat id, URL and day are one.  An empty list passes all; an empty table
    gives no rows.
    """
    fetched = F.col("fetched") if fetched is None else fetched
    spans = cut(intervals(entries), "intervals")
    c = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.to_date(fetched).alias("fetched"))
    size = F.when(F.col("kind") == "path", F.size(F.split("key", F.lit("/"))) - 1).when(F.col("key").startswith("["), 1).otherwise(F.size(F.split("key", F.lit("\\."))))
    sizes = spans.groupBy("kind").agg(F.sum(F.octet_length("key") + F.octet_length("list") + 64).alias("bytes"), F.sort_array(F.collect_set(size)).alias("sizes")).collect()
    depth = {x.kind: F.array(*map(F.lit, x.sizes)) for x in sizes}
    none = F.array().cast("array<int>")
    c = c.withColumn("k", F.explode_outer(keys_of(F.col("url"), depth.get("domain", none), depth.get("path", none)))).select("id", "url", "fetched", "k.kind", "k.key")
    on = ["kind", "key"]
    if sum(x.bytes for x in sizes) <= broadcast_bytes:
        spans = F.broadcast(spans)
    else:
        c = c.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)))
        spans = spans.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on = [*on, "salt"]
    held = (c["fetched"] >= spans["since"]) & (spans["until"].isNull() | (c["fetched"] < spans["until"]))
    cond = held
    for k in on:
        cond = cond & (c[k] == spans[k])
    entry = F.when(F.col("since").isNotNull(), F.struct("list", c["kind"], c["key"]))
    hit = c.join(spans, cond, "left").select("id", c["url"], "fetched", entry.alias("entry"))
    held = hit.groupBy("id", "url", "fetched").agg(F.collect_set("entry").alias("held"))  # sets, as a capture may be repeated
    names = F.array_sort(F.array_distinct(F.transform("held", lambda e: e["list"])))
    out = held.select("id", "url", "fetched", F.size("held").cast("long").alias("n_entries"), F.array_join(names, ",").alias("lists"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "fetched", "n_entries", "lists", (F.col("n_entries") > 0).alias("blocked"))
