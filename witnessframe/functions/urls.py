"""URL and HTML text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def origin(url: Column) -> Column:
    """Lower-case scheme://host[:port] of an http(s) URL without the default port, else null."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, "^.*@", ""))
    default = F.when(scheme == "http", ":80").otherwise(":443")
    bare = F.when(F.endswith(host, default), F.left(host, F.length(host) - F.length(default))).otherwise(host)
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), bare))


def host(url: Column) -> Column:
    authority = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))


def last_index(text: Column, needle: str) -> Column:
    """1-based position of the last occurrence, 0 when absent."""
    at = F.instr(F.reverse(text), needle[::-1])
    return F.when(at == 0, F.lit(0)).otherwise(F.length(text) - at - (len(needle) - 2))


def html_complete(html: Column) -> Column:
    """Holds html and body open and close tags in order and does not end inside a tag."""
    low = F.lower(F.btrim(html))
    tags = [low.contains(t) for t in ("<html", "<body", "</body>", "</html>")]
    present = tags[0] & tags[1] & tags[2] & tags[3]
    ordered = (F.instr(low, "<body") <= last_index(low, "</body>")) & (F.instr(low, "<html") <= last_index(low, "</html>"))
    open_tag = (last_index(low, "<") > 0) & (last_index(low, ">") < last_index(low, "<"))
    return F.coalesce(present & ordered & ~open_tag, F.lit(False))
