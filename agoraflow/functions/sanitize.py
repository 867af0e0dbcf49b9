"""HTML made safe to show."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed sets of HTML names.
DROPPED = {"script", "style", "iframe", "object", "embed", "form", "input", "button", "textarea", "select", "meta", "link", "base", "noscript", "svg", "math", "template"}
VOID = {"input", "embed", "meta", "link", "base"}
RESOURCES = {"src", "srcset", "background", "poster", "data", "lowsrc", "dynsrc", "longdesc", "usemap", "code", "codebase"}
_SCRIPT = re.compile(r"^[\s\x00-\x20]*(?:javascript|vbscript|data)\s*:", re.I)
#: Browsers drop these inside of an address.
_DROPPED = re.compile(r"[\t\r\n\x00]")
_CSS_URL = re.compile(r"url\s*\([^)]*\)", re.I)


class _Cleaner(HTMLParser):
    def __init__(self, trusted: bool):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.depth, self.trusted = 0, trusted

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.depth += tag not in VOID
            return
        if self.depth:
            return
        kept = []
        for k, v in attrs:
            v = v or ""
            if k.startswith("on") or k == "srcdoc":
                continue
            if k == "style":
                v = _CSS_URL.sub("none", v)
            if k in RESOURCES and not v.lower().startswith("cid:") and not (self.trusted and not _SCRIPT.match(_DROPPED.sub("", v))):
                k = f"data-blocked-{k}"
            elif k in ("href", "action", "formaction") and _SCRIPT.match(_DROPPED.sub("", v)):
                continue
            kept.append((k, v))
        if tag == "a" and any(k == "href" and not v.startswith(("#", "mailto:")) for k, v in kept):
            kept = [(k, v) for k, v in kept if k not in ("rel", "target")] + [("rel", "noopener noreferrer nofollow"), ("target", "_blank")]
        self.out.append(f"<{tag}" + "".join(f' {k}="{escape(v)}"' for k, v in kept) + ">")

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.depth = max(0, self.depth - (tag not in VOID))
        elif not self.depth:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.depth:
            self.out.append(escape(data, quote=False))


def sanitized(html: str | None, trusted: bool = False) -> str | None:
    """HTML without active content; remote sources are blocked unless the sender is trusted."""
    if html is None:
        return None
    cleaner = _Cleaner(trusted)
    cleaner.feed(html)
    cleaner.close()
    return "".join(cleaner.out)


@F.pandas_udf(T.StringType())
def sanitize(html: pd.Series) -> pd.Series:
    return html.map(sanitized)
