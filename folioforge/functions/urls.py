"""Addresses: normal form, unwrapped redirects and document ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(?i)(https?)://(?:([^/?#@]*)@)?([^/?#@:]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, no tracking parameters; null if it can't be fetched."""
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    scheme, host = F.lower(part(1)), F.lower(part(3))
    default = F.when(scheme == "http", "80").otherwise("443")
    port = F.when((part(4) == "") | (part(4) == default), "").otherwise(F.concat(F.lit(":"), part(4)))
    user = F.when(part(2) == "", "").otherwise(F.concat(part(2), F.lit("@")))
    path = F.when(part(5) == "", "/").otherwise(part(5))
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)

    def pair(p: Column) -> Column:
        at = F.instr(p, "=")
        key = F.when(at > 0, F.substring(p, F.lit(1), at - 1)).otherwise(p)
        value = F.when(at > 0, F.substring(p, at + 1, F.char_length(p))).otherwise("")
        return F.struct(plain(key).alias("key"), plain(value).alias("value"))

    pairs = F.transform(F.filter(F.split(part(6), "&"), lambda p: p != ""), pair)
    kept = F.filter(pairs, lambda p: ~F.startswith(F.lower(p["key"]), F.lit("utm_")) & (p["key"] != "fbclid"))
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"]))), "&")
    whole = F.concat(scheme, F.lit("://"), user, host, port, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host != "", whole)


def redirect_destination(url: Column) -> Column:
    """The target in a url or uddg parameter, else an embedded url%3d segment up to mkt%3d, else the address itself."""
    asked = F.regexp_extract(url, r"(?i)[?&](?:url|uddg)=([^&#]*)", 1)
    inner = F.regexp_extract(url, r"(?i)url%3d(.*?)(?:(?:%26)?mkt%3d.*)?$", 1)
    return F.coalesce(F.when(asked != "", F.try_url_decode(asked)), F.when(inner != "", F.try_url_decode(inner)), url)


def document_id(url: Column) -> Column:
    return F.sha2(url, 256)


def chunk_id(document: Column, sequence: Column) -> Column:
    return F.sha2(F.concat_ws(":", document, sequence), 256)


def point_id(chunk: Column) -> Column:
    """The first 32 digits of a hash, grouped as a UUID."""
    return F.concat_ws("-", *[F.substring(chunk, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
