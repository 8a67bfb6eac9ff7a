"""URL functions: finding, stripping, dispatching, rewriting, percent-encoding, address checks."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

URL = r"https?://\S+"
# Characters that end a sentence rather than a URL, and hosts by adapter.
TRAILING = r"""[.,)\]>"']+$"""
SHORTENERS = ("share.google", "goo.gl", "bit.ly", "t.co", "lnkd.in")
X_HOSTS = ("x.com", "www.x.com", "twitter.com", "www.twitter.com")
YOUTUBE_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be")
MOST_HOPS = 5


def found_urls(text: Column) -> Column:
    """URLs of a text in order, each once."""
    every = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + URL), F.lit(0))
    return F.array_distinct(F.filter(F.transform(every, lambda u: F.regexp_replace(u, TRAILING, "")), lambda u: u != ""))


def note_urls(frontmatter_values: Column, body: Column) -> Column:
    """URLs of a note: those of the frontmatter's values in key order, then those of the body, each once."""
    first = F.flatten(F.transform(frontmatter_values, found_urls))
    return F.array_distinct(F.concat(first, found_urls(body)))


def commentary(text: Column) -> Column:
    """A message without its URLs, white space collapsed; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(text, "(?U)" + URL, " "), r"(?U)\s+", " ")
    return F.nullif(F.trim(bare), F.lit(""))


def hostname(url: Column) -> Column:
    """Lower-cased host without user and port; null if there is none. Lenient: a blank in the rest does no harm."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def adapter(url: Column) -> Column:
    """Which adapter extracts a URL; the first rule that fits. The host is taken once, not for every rule."""

    def by_host(host: Column) -> Column:
        return (
            F.when(host.isNull(), F.lit("error"))
            .when(host.isin(*SHORTENERS), F.lit("shortener"))
            .when(host == "vm.tiktok.com", F.lit("vm_tiktok"))
            .when((host == "tiktok.com") | host.endswith(".tiktok.com"), F.lit("tiktok"))
            .when(host.isin(*X_HOSTS), F.lit("x"))
            .when(host.isin(*YOUTUBE_HOSTS), F.lit("youtube"))
            .otherwise(F.lit("generic"))
        )

    return F.element_at(F.transform(F.array(hostname(url)), by_host), 1)


def quoted(text: Column) -> Column:
    """Percent-encoding that keeps letters, digits and ``_.-~`` only."""
    form = F.url_encode(text)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        form = F.replace(form, F.lit(old), F.lit(new))
    return form


def without_query(url: Column) -> Column:
    """The URL without its query; a fragment stays."""
    return F.regexp_replace(url, r"\?[^#]*", "")


def request_url(url: Column) -> Column:
    """What is actually fetched for a URL: oEmbed endpoints, the tweet API's host, or the URL itself."""
    def by_adapter(kind: Column) -> Column:
        return (
            F.when(kind == "tiktok", F.concat(F.lit("https://www.tiktok.com/oembed?url="), quoted(url)))
            .when(kind == "youtube", F.concat(F.lit("https://www.youtube.com/oembed?url="), quoted(url), F.lit("&format=json")))
            .when(kind == "x", F.regexp_replace(url, "^([a-zA-Z]+://)[^/?#]*", "$1api.fxtwitter.com"))
            .otherwise(url)
        )

    return F.element_at(F.transform(F.array(adapter(url)), by_adapter), 1)


def resolved(urls: DataFrame, redirects: DataFrame, most_hops: int = MOST_HOPS) -> DataFrame:
    """``url, final_url, hops, error``: follow ``redirects`` (``url, final_url``) while the host is a shortener.

    One join for each hop; URLs that need no hop are not joined at all. After ``most_hops`` a URL that is
    still a shortener is an error, as is one without a known redirect.
    """
    jumps = redirects.select(F.col("url").alias("at"), F.col("final_url").alias("to"))
    now = urls.select("url", F.col("url").alias("at"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("error"))
    done = now.where(F.coalesce(adapter(F.col("at")), F.lit("error")) != "shortener")
    now = now.where(adapter(F.col("at")) == "shortener")
    for _ in range(most_hops):
        moved = now.join(jumps, "at", "left").select("url", F.coalesce("to", "at").alias("at"), (F.col("hops") + F.col("to").isNotNull().cast("int")).alias("hops"), F.when(F.col("to").isNull(), F.lit("fetch failed")).alias("error"))
        settled = F.col("error").isNotNull() | (adapter(F.col("at")) != "shortener")
        done = done.unionByName(moved.where(settled))
        now = moved.where(~settled)
    late = now.withColumn("error", F.lit(f"redirect loop: exceeded {most_hops} shortener hops"))
    return done.unionByName(late).select("url", F.col("at").alias("final_url"), "hops", "error")


@F.pandas_udf(T.BooleanType())
def refused(hosts: pd.Series) -> pd.Series:
    """Whether a host is an address that must not be fetched: loopback, private, link-local, reserved; unparsable hosts too."""

    def check(host: str | None) -> bool:
        if not host:
            return True
        if host == "localhost":
            return True
        try:
            ip = ipaddress.ip_address(host.strip("[]"))
        except ValueError:
            return False
        return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified

    return hosts.map(check)
