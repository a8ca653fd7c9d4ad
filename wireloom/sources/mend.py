"""Small scanners over a document's bytes: its declaration, bare attribute values, links that are left open.

Each walks from mark to mark with find() and copies what lies between; nothing is looked at twice.
"""

from __future__ import annotations

from dataclasses import dataclass

_SPACE = b" \t\n\r\f\v"
_NAME = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_:")
_STOP = frozenset(_SPACE + b">\"'")


@dataclass(frozen=True)
class Declaration:
    """Where the value of a declaration's encoding stands."""

    start: int
    end: int
    name: bytes


def declaration(head: bytes) -> Declaration | None:
    """The encoding that the first XML declaration with one names: <?xml ... encoding="name" ... ?>."""
    low, at = head.lower(), 0
    while (at := low.find(b"<?xml", at)) >= 0:
        stop = low.find(b">", at)
        if stop < 0:
            return None
        if low[stop - 1 : stop] == b"?":
            key = low.rfind(b"encoding=", at, stop)
            while key >= 0:
                start = key + len(b"encoding=") + 1
                if low[start - 1 : start] in (b'"', b"'"):
                    ends = [e for e in (low.find(b'"', start, stop), low.find(b"'", start, stop)) if e >= 0]
                    if ends and min(ends) > start:
                        return Declaration(start, min(ends), low[start : min(ends)])
                key = low.rfind(b"encoding=", at, key)
        at += 1
    return None


def renamed(head: bytes, name: bytes) -> bytes:
    """head with another name in its declaration."""
    found = declaration(head)
    return head[: found.start] + name + head[found.end :] if found else head


def _past_space(raw: bytes, at: int) -> int:
    while at < len(raw) and raw[at] in _SPACE:
        at += 1
    return at


def single_declaration(head: bytes) -> bytes:
    """<?xml?xml and white space as one <?xml, ??> and white space as ?>."""
    out, low, at = [], head.lower(), 0
    while at < len(head):
        doubled, closed = low.find(b"<?xml?xml", at), low.find(b"??>", at)
        mark = min((x for x in (doubled, closed) if x >= 0), default=-1)
        if mark < 0:
            break
        out.append(head[at:mark])
        after = mark + (9 if mark == doubled else 3)
        at = _past_space(head, after)
        if mark == closed:
            out.append(b"?>")
        else:
            out.append(b"<?xml " if at > after else head[mark:after])
    return b"".join(out) + head[at:]


def quoted_values(raw: bytes) -> bytes:
    """A value that follows a name and = without quotes gets them, wherever white space stands before the name."""
    out, copied, at = [], 0, 0
    while (at := raw.find(b"=", at)) >= 0:
        name = at
        while name > copied and raw[name - 1] in _NAME:
            name -= 1
        end = at + 1
        if name < at and name > copied and raw[name - 1] in _SPACE:
            while end < len(raw) and raw[end] not in _STOP:
                end += 1
            if end > at + 1:
                out += [raw[copied : at + 1], b'"', raw[at + 1 : end], b'"']
                copied = end
        at = end
    return b"".join(out) + raw[copied:]


def closed_links(raw: bytes) -> bytes:
    """<link ...> before a line that starts with another tag than its end tag becomes <link .../>."""
    out, copied, at = [], 0, 0
    while (at := raw.find(b"<link", at)) >= 0:
        inner, stop = at + len(b"<link"), raw.find(b">", at)
        if stop < 0:
            break
        after = _past_space(raw, stop + 1)
        line = raw.rfind(b"\n", stop + 1, after)
        ends = raw[after : after + 6] == b"</link" and raw[_past_space(raw, after + 6) :][:1] == b">"
        if stop > inner and raw[stop - 1 : stop] != b"/" and line >= 0 and raw[after : after + 1] == b"<" and not ends:
            out += [raw[copied:stop], b"/>"]
            copied = line
        at = max(stop, line)
    return b"".join(out) + raw[copied:]
