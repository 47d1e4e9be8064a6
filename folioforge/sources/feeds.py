"""Search results from provider responses, as tables (title, url, position)."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import trim
from folioforge.functions.urls import normalize_url, redirect_destination

MAX_BYTES = 2 * 1024 * 1024

_RSS = "channel struct<item:array<struct<title:string,link:string>>>, item array<struct<title:string,link:string>>"
_ATOM = "entry array<struct<title:string,link:array<struct<_href:string,_rel:string>>>>"


def listed(found: DataFrame) -> DataFrame:
    """Rows with a title and a fetchable address, redirects unwrapped."""
    rows = found.withColumn("url", normalize_url(redirect_destination(trim(F.col("url"))))).withColumn("title", trim(F.col("title")))
    return rows.filter(F.col("url").isNotNull() & (F.col("title") != ""))


def rss(responses: DataFrame, body: str = "body") -> DataFrame:
    """Items of RSS and entries of Atom feeds, not made unique: repeats are found against the catalog."""
    small = responses.filter(F.octet_length(body) <= MAX_BYTES)
    item = F.from_xml(F.col(body), _RSS)
    entry = F.from_xml(F.col(body), _ATOM)
    items = F.coalesce(item["channel"]["item"], item["item"])
    linked = F.transform(entry["entry"], lambda e: F.struct(e["title"].alias("title"), F.get(F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"].alias("link")))
    both = F.concat(F.coalesce(items, F.array().cast("array<struct<title:string,link:string>>")), F.coalesce(linked, F.array().cast("array<struct<title:string,link:string>>")))
    return listed(small.select(F.posexplode(both).alias("position", "r")).select("position", F.col("r.title").alias("title"), F.col("r.link").alias("url")))


def _unique(found: DataFrame) -> DataFrame:
    """The first row of each address."""
    return found.groupBy("url").agg(F.min(F.struct("position", "title")).alias("r")).select("r.position", "r.title", "url")


def _json(responses: DataFrame, results: Column) -> DataFrame:
    rows = responses.select(F.posexplode(results).alias("position", "r")).select("position", F.col("r.title").alias("title"), F.col("r.url").alias("url"))
    return _unique(listed(rows))


def brave(responses: DataFrame, body: str = "body") -> DataFrame:
    return _json(responses, F.from_json(body, "web struct<results:array<struct<title:string,url:string>>>")["web"]["results"])


def duckduckgo(responses: DataFrame, body: str = "body") -> DataFrame:
    """A JSON list of results, which may itself be encoded as a JSON string."""
    kind = "array<struct<title:string,url:string>>"
    inner = F.from_json(F.concat(F.lit('{"s":'), F.col(body), F.lit("}")), "s string")["s"]
    return _json(responses, F.coalesce(F.from_json(F.when(F.startswith(trim(F.col(body)), F.lit("[")), F.col(body)), kind), F.from_json(inner, kind)))


PROVIDERS: dict[str, Callable[[DataFrame], DataFrame]] = {"rss": rss, "brave": brave, "duckduckgo": duckduckgo}


def first_results(found: DataFrame, limit: int) -> DataFrame:
    return found.orderBy("position").limit(limit)


# configuration

_VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")


def expand(value: str, env: dict[str, str] | None = None) -> str:
    """${NAME} and ${NAME:-default} replaced; an unset name without default or an open expression is an error."""
    env = dict(os.environ) if env is None else env

    def one(m: re.Match) -> str:
        got = env.get(m[1]) or m[2]
        if got is None:
            raise ValueError(f"{m[1]} is not set")
        return got

    out = _VARIABLE.sub(one, value)
    if "${" in out:
        raise ValueError(f"unterminated expression in {value!r}")
    return out


@dataclass(frozen=True)
class Settings:
    provider: str = "rss"
    fetcher: str = "http"
    endpoint: str = ""
    parameters: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.provider not in PROVIDERS:
            raise ValueError(f"unknown provider {self.provider}")
        if self.fetcher not in ("http", "browser"):
            raise ValueError(f"unknown fetcher {self.fetcher}")


def settings(text: str, env: dict[str, str] | None = None) -> Settings:
    """Settings from YAML; unknown fields are errors."""
    import yaml

    given = yaml.safe_load(expand(text, env)) or {}
    unknown = set(given) - {"provider", "fetcher", "endpoint", "parameters"}
    if unknown:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    return Settings(**given)
