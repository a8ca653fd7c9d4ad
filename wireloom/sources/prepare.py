"""Repair of a document's bytes before it is parsed as XML. Limits are part of the rules."""

from __future__ import annotations

import re

from .mend import closed_links, declaration, quoted_values, renamed, single_declaration

HTML_ERROR = "Content appears to be HTML, not a valid RSS/Atom feed"

# Marks that the rules are stated in.
_STARTS = (b"<?xml", b"<rss", b"<feed", b"<rdf")
_EMBEDDED = re.compile(rb"<\?xml|<rss|<feed|<rdf:rdf")
_BOM = b"\xef\xbb\xbf"
#: Bytes in which the declaration is looked for, and in which it is mended.
_DECLARED_IN, _MENDED_IN = 2000, 2048


class Rejected(ValueError):
    """A document that is no feed; the message says why."""


def trim_junk(raw: bytes) -> bytes:
    """The document from its first XML mark on; HTML is rejected."""
    bare = raw.lstrip()
    bare = bare.removeprefix(_BOM)
    head = bare[:2000].lower()
    if head.startswith(_STARTS):
        return bare
    if head.startswith((b"<!doctype html", b"<html")):
        raise Rejected(HTML_ERROR)
    if m := _EMBEDDED.search(raw[:8192].lower()):
        return raw[m.start() :]
    if b"<script>" in head or b"<body>" in head:
        raise Rejected(HTML_ERROR)
    return raw


def declared_encoding(raw: bytes) -> str:
    """By byte order mark, then by declaration, else UTF-8."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    if raw.startswith(_BOM):
        return "utf-8"
    found = declaration(raw[:_DECLARED_IN])
    return found.name.decode("ascii", "replace") if found else "utf-8"


def _mend(raw: bytes, actual: str) -> bytes:
    head = single_declaration(raw[:_MENDED_IN])
    found = declaration(head)
    if actual != "utf-16" and found and found.name in (b"utf-16", b"utf-16-le", b"utf-16-be"):
        head = renamed(head, actual.encode("ascii", "replace"))
    return closed_links(quoted_values(head + raw[_MENDED_IN:]))


def prepare(raw: bytes) -> bytes:
    """Bytes that an XML parser can start on."""
    raw = trim_junk(raw)
    if not raw:
        raise Rejected("Empty content")
    if b"\xe2\x80\xa8" in raw[:65536] or b"\xe2\x80\xa9" in raw[:65536]:
        raw = raw.replace(b"\xe2\x80\xa8", b"\n").replace(b"\xe2\x80\xa9", b"\n")
    declared = declared_encoding(raw)
    actual = "utf-8" if declared.startswith("utf-16") and b"\0" not in raw[:200] else declared
    start = raw[:200].lower()
    unbound = b"rss:" in raw[:500].lower() and b"xmlns:rss" not in raw[:1000].lower()
    if b"?xml?xml" in start or b"??>" in start or unbound or (b"utf-16" in start and actual != "utf-16"):
        raw = _mend(raw, actual)
    return raw


def encode_text(text: str) -> bytes:
    """A text as UTF-8 whose declaration, if it has one, says so."""
    raw = text.encode("utf-8", "replace")
    return renamed(raw, b"utf-8") if text.lstrip().startswith("<?xml") else raw
