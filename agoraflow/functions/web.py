"""Paths, queries and headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(url: Column, base: str = "") -> Column:
    """The decoded path segments of a URL or path, empty ones and the base path left out. A plus sign stays."""
    path = F.regexp_replace(F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    if base:
        path = F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)
    plain = lambda s: F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), plain)


def query_params(url: Column) -> Column:
    """The query of a URL as a map, empty if there is none; of equal names the last counts under LAST_WIN."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.when(query == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(query, F.lit("&"), F.lit("=")))


def page_url(base: Column, token: Column, rewrite: bool) -> Column:
    """A page's address: as a path or as a query."""
    return F.concat_ws("/", base, F.url_encode(token)) if rewrite else F.concat(base, F.lit("?page="), F.url_encode(token))


def state_query(**values: tuple[Column, Column]) -> Column:
    """name=value of each (value, default) that differs from its default."""
    part = lambda k, v, d: F.when(~v.eqNullSafe(d), F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))))
    return F.array_join(F.array_compact(F.array(*[part(k, v, d) for k, (v, d) in values.items()])), "&")


def state_path(*values: tuple[Column, Column]) -> Column:
    """Segments up to the last value that differs from its default; defaults before it are spelt out."""
    out = F.lit("")
    for v, d in reversed(values):
        own = F.coalesce(v, d).cast("string")
        out = F.when(out != "", F.concat(own, F.lit("/"), out)).when(~v.eqNullSafe(d), own).otherwise(F.lit(""))
    return out


def bearer(header: Column) -> Column:
    return F.nullif(F.regexp_extract(header, r"(?i)^Bearer\s+(\S+)$", 1), F.lit(""))


def headers(raw: Column) -> Column:
    """Header lines as a map with lower-case names: folded lines joined, the last of equal names kept under LAST_WIN."""
    lines = F.split(F.regexp_replace(F.regexp_replace(raw, "\r\n", "\n"), "\n[ \t]+", " "), "\n")
    pairs = F.filter(lines, lambda x: x.contains(":"))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))), F.trim(F.regexp_replace(x, "^[^:]*:", "")))))


def head_and_body(raw: Column) -> Column:
    """[head, body] of a message at its first blank line."""
    return F.split(raw, "\r?\n\r?\n", 2)


def filter_query(**values: Column) -> Column:
    """name=value of all values that are not null, encoded, joined by &."""
    return F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in values.items()])), "&")


def method_class(method: Column) -> Column:
    """safe, idempotent or unsafe."""
    m = F.upper(method)
    return F.when(m.isin("GET", "HEAD", "OPTIONS", "TRACE"), "safe").when(m.isin("PUT", "DELETE"), "idempotent").otherwise("unsafe")


def uri_text(scheme: Column, host: Column, port: Column, path: Column, query: Column) -> Column:
    """An address put together; the port that the scheme implies is left out, as are empty parts."""
    usual = F.when(scheme == "http", 80).when(scheme == "https", 443)
    shown = F.when(port.isNotNull() & ~port.eqNullSafe(usual), F.concat(F.lit(":"), port.cast("string"))).otherwise("")
    rest = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.concat(scheme, F.lit("://"), host, shown, rest, F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("?"), query)).otherwise(""))


def client_ip(remote: Column, forwarded: Column, trusted: bool) -> Column:
    """The peer's address, or behind a trusted proxy the first public IPv4 address of the forwarded list."""
    if not trusted:
        return remote
    parts = F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda x: F.trim(x))
    private = r"^(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)"
    public = F.filter(parts, lambda x: x.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") & ~x.rlike(private))
    return F.coalesce(F.get(public, F.lit(0)), remote)
