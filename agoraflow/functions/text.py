"""Texts, numbers and typed readings of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = [("y", 365 * 86400), ("mo", 30 * 86400), ("w", 7 * 86400), ("d", 86400), ("h", 3600), ("m", 60), ("s", 1)]


def duration(seconds: Column) -> Column:
    """The two largest parts of a duration, such as 2d 3h; 0s for nothing."""
    rest, parts = seconds.cast("long"), []
    for unit, size in _UNITS:
        n = F.floor(rest / size).cast("long")
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))))
        rest = rest % size
    return F.when(seconds > 0, F.array_join(F.slice(F.array_compact(F.array(*parts)), 1, 2), " ")).otherwise(F.when(seconds.isNotNull(), "0s"))


def byte_size(n: Column) -> Column:
    """A size in B, KB or MB, the latter two with one decimal."""
    shown = lambda d, unit: F.concat(F.format_string("%.1f", F.round(n / d, 1)), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, shown(1024, " KB")).otherwise(shown(1048576, " MB"))


def email_of(address: Column) -> Column:
    """The address in angle brackets, else the text if it has an @, in lower case; else null."""
    inner = F.regexp_extract(address, "<([^>]+)>", 1)
    return F.lower(F.when(inner != "", inner).when(address.contains("@"), F.trim(address)))


def reply_subject(subject: Column) -> Column:
    return F.concat(F.lit("Re: "), F.regexp_replace(subject, r"(?i)^(Re:\s*)+", ""))


def quoted(text: Column) -> Column:
    """Each line with > before it."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9._-]", "_")


def html_escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def typed_int(text: Column) -> Column:
    """A whole number, else null."""
    return F.when(text.rlike(r"^-?\d+$"), text.try_cast("bigint"))


def typed_bool(text: Column) -> Column:
    """true for 1, true, on, yes; false for 0, false, off, no; else null."""
    low = F.lower(text)
    return F.when(low.isin("1", "true", "on", "yes"), True).when(low.isin("0", "false", "off", "no"), False)


def lenient_int(text: Column, default: int) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(default))


def class_name(slug: Column) -> Column:
    """my_page becomes MyPage."""
    return F.replace(F.initcap(F.replace(slug, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def code_key(code: Column) -> Column:
    return F.regexp_replace(code, "[/.-]", "__")


def display_name(user_name: Column, guest_name: Column) -> Column:
    """The user's name, else the guest's if not empty, else Anonymous."""
    return F.coalesce(user_name, F.nullif(guest_name, F.lit("")), F.lit("Anonymous"))


def identicon_seed(name: Column, ip: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(name, F.lit("")), F.coalesce(ip, F.lit(""))), 256)


def status_class(status: Column) -> Column:
    """The hundreds of an HTTP status, 1 to 5, else null."""
    c = F.floor(status / 100).cast("int")
    return F.when(c.between(1, 5), c)


def interpolated(template: Column, values: Column) -> Column:
    """A template with each {name} replaced by the map's value, all at once; unknown names stay, null values vanish."""
    parts = F.split(template, r"(?=\{\w+\})|(?<=\})")
    known = lambda p: F.map_contains_key(values, F.regexp_extract(p, r"^\{(\w+)\}$", 1))
    fill = lambda p: F.when(known(p), F.coalesce(F.element_at(values, F.regexp_extract(p, r"^\{(\w+)\}$", 1)), F.lit(""))).otherwise(p)
    return F.array_join(F.transform(parts, fill), "")


def css_minified(css: Column) -> Column:
    bare = F.regexp_replace(css, r"(?s)/\*.*?\*/", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"\s*([{};:,>])\s*", "$1"))


def lenient_bool(text: Column) -> Column:
    """false for null, the empty text and 0, else true."""
    return F.coalesce((text != "") & (text != "0"), F.lit(False))


def normalised(name: Column, case_sensitive: bool = False) -> Column:
    return name if case_sensitive else F.lower(name)


def hex_colour(text: Column, default: str = "000000") -> Column:
    """Six hexadecimal digits after an optional #, in lower case; else the default."""
    found = F.regexp_extract(F.trim(text), r"^#?([0-9a-fA-F]{6})$", 1)
    return F.when(F.coalesce(found, F.lit("")) != "", F.lower(found)).otherwise(default)


def labelled(code: Column, labels: dict, default: str) -> Column:
    """The label of a code, else the default."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.element_at(known, code), F.lit(default))


def locale_of(text: Column, known: list[str], default: str) -> Column:
    low = F.lower(F.left(F.trim(text), F.lit(2)))
    return F.when(low.isin(*known), low).otherwise(default)


def leaf(name: Column, delimiter: str) -> Column:
    """The part of a folder's name after the last delimiter."""
    return F.substring_index(name, delimiter, -1)
