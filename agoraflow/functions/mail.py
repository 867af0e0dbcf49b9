"""Messages: MIME structure, encoded words, envelopes and message texts."""

from __future__ import annotations

import email
import email.header
import email.policy
import quopri
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = ["subject", "sender", "recipients", "date", "text", "html"]
_ATTACHMENT = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("size", T.LongType())])
MESSAGE = T.StructType([*[T.StructField(x, T.StringType()) for x in _TEXTS], T.StructField("attachments", T.ArrayType(_ATTACHMENT))])
_ENCODED = re.compile(r"=\?[^?]+\?[bBqQ]\?[^?]*\?=")


def decoded_words(value: str | None) -> str | None:
    """A header with its encoded words in plain text."""
    if value is None or not _ENCODED.search(value):
        return value
    parts = []
    for data, charset in email.header.decode_header(value):
        parts.append(data if isinstance(data, str) else to_text(data, charset or "ascii"))
    return "".join(parts)


def to_text(data: bytes, charset: str) -> str:
    """Bytes in a charset as text; what it lacks, or an unknown charset, falls back to UTF-8 with replacement."""
    try:
        return data.decode(charset, "ignore")
    except LookupError:
        return data.decode("utf-8", "replace")


def parsed_message(raw: bytes | None) -> dict:
    """A message's headers, its first text and HTML part, and its attachments."""
    m = email.message_from_bytes(raw or b"", policy=email.policy.compat32)
    out = {"subject": decoded_words(m["subject"]), "sender": decoded_words(m["from"]), "recipients": decoded_words(m["to"]), "date": m["date"], "text": "", "html": "", "attachments": []}
    for part in m.walk():
        if part.is_multipart():
            continue
        kind, name = part.get_content_type(), part.get_filename()
        data = part.get_payload(decode=True) or b""
        field = {"text/plain": "text", "text/html": "html"}.get(kind)
        if field and not name and part.get_content_disposition() != "attachment":
            out[field] = out[field] or to_text(data, part.get_content_charset() or "utf-8")
        else:
            out["attachments"].append({"name": decoded_words(name) or "", "type": kind, "size": len(data)})
    return out


@F.pandas_udf(MESSAGE)
def message(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parsed_message(x) for x in raw], columns=MESSAGE.names)


def envelope_tokens(text: str) -> list:
    """An IMAP list as nested lists: quoted strings and atoms become texts, NIL None."""
    stack: list[list] = [[]]
    for m in re.finditer(r'"((?:[^"\\]|\\.)*)"|([()])|([^\s()"]+)', text):
        if m[1] is not None:
            stack[-1].append(re.sub(r"\\(.)", r"\1", m[1]))
        elif m[2] == "(":
            stack.append([])
        elif m[2] == ")":
            if len(stack) > 1:
                done = stack.pop()
                stack[-1].append(done)
        else:
            stack[-1].append(None if m[3].upper() == "NIL" else m[3])
    while len(stack) > 1:
        done = stack.pop()
        stack[-1].append(done)
    return stack[0]


def addresses(items: list | None) -> str:
    """(name route local domain) lists as text."""
    shown = [(f"{decoded_words(i[0])} <{i[2]}@{i[3]}>" if i[0] else f"{i[2]}@{i[3]}") for i in items or [] if isinstance(i, list) and len(i) == 4]
    return ", ".join(shown)


def built_message(headers: dict[str, str], text: str, html: str = "", boundary: str = "part") -> str:
    """A message with quoted-printable bodies, of two alternatives if there is HTML."""
    qp = lambda s: quopri.encodestring(s.encode()).decode().replace("\r\n", "\n").replace("\n", "\r\n")
    head = [f"{k}: {v}" for k, v in headers.items()] + ["MIME-Version: 1.0"]
    part = lambda kind, s: [f"Content-Type: text/{kind}; charset=utf-8", "Content-Transfer-Encoding: quoted-printable", "", qp(s)]
    if not html:
        return "\r\n".join(head + part("plain", text))
    return "\r\n".join([*head, f'Content-Type: multipart/alternative; boundary="{boundary}"', "", f"--{boundary}", *part("plain", text), f"--{boundary}", *part("html", html), f"--{boundary}--", ""])
