"""Reading values from node arrays, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import first_nonempty, nonempty, ustrip

Test = Callable[[Column], Column]


def first(nodes: Column, test: Test) -> Column:
    """The first node that passes; null if none does."""
    return F.get(F.filter(nodes, test), F.lit(0))


def tagged(tag: Column | str) -> Test:
    return lambda n: n["tag"] == tag


def local(name: str) -> Test:
    return lambda n: n["local"] == name


def attr(holder: Column, name: str | Column) -> Column:
    """An attribute's value; null if there is none."""
    return F.try_element_at(holder["attrs"], name if isinstance(name, Column) else F.lit(name))


def stripped(c: Column) -> Column:
    """Stripped text; null stays null."""
    return ustrip(c)


def text_of(kids: Column, name: str) -> Column:
    """The text of the first child with a local name, even if it has none and a later one has."""
    return first(kids, local(name))["text"]


def text_of_any(kids: Column, *names: str) -> Column:
    """The first text that one of the names has."""
    return F.coalesce(*[text_of(kids, n) for n in names])


def first_text(kids: Column, tag: Column | str) -> Column:
    """The first text among all children of a tag."""
    return first(kids, lambda n: (n["tag"] == tag) & n["text"].isNotNull())["text"]


class Getter:
    """Values by path from an element's nodes: kids are its children, grand its grandchildren.

    A plain name that is not found is looked for behind the literal prefixes rss:, atom: and dc: (in any case, the last such
    child). Values are stripped.
    """

    def __init__(self, kids: Column, grand: Column) -> None:
        self._kids, self._grand = kids, grand

    def node(self, tag: Column | str, plain: bool = False) -> Column:
        found = first(self._kids, tagged(tag))
        if not plain:
            return found

        def behind(prefix: str) -> Column:
            return F.try_element_at(F.filter(self._kids, lambda n: F.lower(n["tag"]) == f"{prefix}:{tag.lower()}"), F.lit(-1))

        return F.coalesce(found, *map(behind, ("rss", "atom", "dc")))

    def plain(self, name: str) -> Column:
        return stripped(self.node(name, True)["text"])

    def tag(self, tag: Column | str) -> Column:
        return stripped(self.node(tag)["text"])

    def attr(self, tag: Column | str, name: str) -> Column:
        return stripped(nonempty(attr(self.node(tag), name)))

    def plain_attr(self, name: str, attribute: str) -> Column:
        return stripped(nonempty(attr(self.node(name, True), attribute)))

    def path(self, up: Column | str, tag: Column | str) -> Column:
        """The first grandchild of a tag below a child of a tag."""
        return stripped(first(self._grand, lambda n: (n["up"] == up) & (n["tag"] == tag))["text"])


__all__ = ["Getter", "attr", "first", "first_nonempty", "first_text", "local", "nonempty", "stripped", "tagged", "text_of", "text_of_any"]
