"""XML into a small tree: strictly where the document allows it, else by a tolerant reader.

The tolerant reader's rules: names and attributes may be unquoted; an end tag closes the nearest element of its name and
all within, and is ignored if there is none; the end of input closes what is open; an ampersand that starts no known
reference is text; an undeclared prefix stays part of the name; an unfinished section of character data is dropped; what
follows the root is ignored.
"""

from __future__ import annotations

import html
import re
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

XML = "http://www.w3.org/XML/1998/namespace"


class Element:
    __slots__ = ("attrs", "children", "name", "parent", "raw", "scope", "tag", "tail", "text", "_open")

    def __init__(self, name: str, raw: dict[str, str], parent: Element | None) -> None:
        self.name, self.raw, self.parent, self.children, self.text, self.tail, self._open = name, raw, parent, [], "", "", True
        scope = parent.scope if parent is not None else {"xml": XML}
        if any(k == "xmlns" or k.startswith("xmlns:") for k in raw):
            scope = scope | {k[6:]: v for k, v in raw.items() if k == "xmlns" or k.startswith("xmlns:")}
        self.scope = scope
        self.tag = self._resolve(name, True)
        self.attrs = {self._resolve(k, False): v for k, v in raw.items() if k != "xmlns" and not k.startswith("xmlns:")}

    def _resolve(self, name: str, element: bool) -> str:
        prefix, colon, local = name.partition(":")
        if not colon:
            space = self.scope.get("") if element else None
            return f"{{{space}}}{name}" if space else name
        space = self.scope.get(prefix)
        return f"{{{space}}}{local}" if space else name

    @property
    def local(self) -> str:
        return self.tag.rsplit("}", 1)[-1]

    def iter(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def all_text(self):
        """Texts in document order (without those of comments)."""
        yield self.text
        for child in self.children:
            yield from child.all_text()
            yield child.tail

    def serialise(self, top: bool = True) -> str:
        """The element as markup, with the namespaces that are in scope, and with the text that follows it."""
        spaces = {k: v for k, v in self.scope.items() if k != "xml"} if top else {k[6:]: v for k, v in self.raw.items() if k == "xmlns" or k.startswith("xmlns:")}
        attrs = "".join(f" xmlns{':' + k if k else ''}={quoteattr(v)}" for k, v in spaces.items())
        attrs += "".join(f" {k}={quoteattr(v)}" for k, v in self.raw.items() if k != "xmlns" and not k.startswith("xmlns:"))
        inner = escape(self.text) + "".join(c.serialise(False) for c in self.children)
        return (f"<{self.name}{attrs}>{inner}</{self.name}>" if inner else f"<{self.name}{attrs}/>") + escape(self.tail)


class _Builder:
    def __init__(self) -> None:
        self.root: Element | None = None
        self.at: Element | None = None

    def start(self, name: str, attrs: dict[str, str]) -> None:
        node = Element(name, attrs, self.at)
        if self.at is None:
            self.root = self.root or node
        else:
            self.at._open = False
            self.at.children.append(node)
        self.at = node

    def end(self, _name: str | None = None) -> None:
        self.at = self.at.parent

    def data(self, text: str) -> None:
        if self.at is None:
            return
        if self.at.children:
            self.at.children[-1].tail += text
        elif self.at._open:
            self.at.text += text

    def mark(self, *_) -> None:
        """A comment or instruction: the element's own text ends here."""
        if self.at is not None:
            self.at._open = False


def read_strict(raw: bytes) -> Element:
    """The root of a well-formed document; expat's error otherwise."""
    b, parser = _Builder(), expat.ParserCreate()
    parser.buffer_text, parser.buffer_size = True, 1 << 16
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = b.start, b.end, b.data
    parser.CommentHandler = parser.ProcessingInstructionHandler = b.mark
    parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)

    def entity(name, is_parameter, value, *_):  # entities of the document's own are not expanded
        raise expat.ExpatError(f"entity {name}")

    parser.EntityDeclHandler = entity
    parser.Parse(raw, True)
    if b.root is None:
        raise expat.ExpatError("no element")
    return b.root


_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<!\[CDATA\[.*$|<\?.*?(?:\?>|$)|<![^>]*>?|</(?P<end>[^\s>]+)[^>]*>?|<(?P<start>[A-Za-z_][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_REFERENCE = re.compile(r"&(#\d+|#[xX][0-9a-fA-F]+|amp|lt|gt|quot|apos);")
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def _text(s: str, markup: bool) -> str:
    s = _BAD.sub("", s)
    return html.unescape(s) if markup else _REFERENCE.sub(lambda m: html.unescape(m[0]), s)


def decode(raw: bytes) -> str:
    """By byte order mark or declaration, with replacement characters for what does not fit."""
    from .prepare import declared_encoding

    name = declared_encoding(raw)
    try:
        return raw.decode(name, "replace").lstrip("﻿")
    except LookupError:
        return raw.decode("utf-8", "replace")


def read_tolerant(raw: bytes, markup: bool = False) -> Element | None:
    """The root that can be made out, or None. markup: as HTML, with lower-cased names, void elements and all named references."""
    b, text, at = _Builder(), decode(raw), 0
    for m in _TOKEN.finditer(text):
        if b.root is not None and b.at is None and not markup:
            break
        if m.start() > at:
            b.data(_text(text[at : m.start()], markup))
        at = m.end()
        if m["cdata"] is not None:
            b.data(_BAD.sub("", m["cdata"]))
        elif m["end"] is not None:
            name = m["end"].lower() if markup else m["end"]
            node = b.at
            while node is not None and node.name != name:
                node = node.parent
            if node is not None:
                b.at = node.parent
        elif m["start"] is not None:
            attrs = m["attrs"]
            closed = attrs.rstrip().endswith("/")
            name = m["start"].lower() if markup else m["start"]
            if b.at is None and b.root is not None:
                continue  # a second root
            found = {}
            for k, *values in _ATTR.findall(attrs[: attrs.rstrip().rfind("/")] if closed else attrs):
                found.setdefault(k.lower() if markup else k, _text("".join(values), markup))
            b.start(name, found)
            if closed or (markup and name in _VOID):
                b.end()
        else:
            b.mark()
    if b.at is not None and at < len(text):
        b.data(_text(text[at:], markup))
    return b.root


def read_html(raw: bytes) -> Element | None:
    """HTML under one root, whatever stands at its top."""
    return read_tolerant(b"<html>" + raw + b"</html>", True) if raw.strip() else None


def read(raw: bytes) -> Element | None:
    """Strictly, or else tolerantly."""
    try:
        return read_strict(raw)
    except (expat.ExpatError, ValueError, LookupError):
        return read_tolerant(raw)
