"""Documents into nodes: the one step that needs Python. Everything after it is Column expressions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..names import MEDIA, SHREDDED
from ..sources.prepare import Rejected, encode_text, prepare
from ..sources.xmltree import Element, read
from .structure import find_feed, reject_other_roots

#: Documents in an Arrow batch.
BATCH = 64

_MARKUP = {"xhtml", "application/xhtml+xml"}
_MEDIA = f"{{{MEDIA}}}"


class _Maps:
    """An Arrow column of attributes, built as flat lists."""

    def __init__(self) -> None:
        self.offsets, self.keys, self.values = [0], [], []

    def add(self, attrs: dict[str, str]) -> None:
        if attrs:
            self.keys += attrs
            self.values += attrs.values()
        self.offsets.append(len(self.keys))

    def array(self) -> pa.Array:
        return pa.MapArray.from_arrays(pa.array(self.offsets, pa.int32()), pa.array(self.keys, pa.string()), pa.array(self.values, pa.string()))


class _Parts:
    """An Arrow column of parts: the attributes and nodes of a channel or an item, built as flat lists without an object for
    each node."""

    def __init__(self, media: bool) -> None:
        self._media = media
        self.attrs, self.node_attrs, self.offsets = _Maps(), _Maps(), [0]
        self.nodes: tuple[list, ...] = tuple([] for _ in range(9))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def add(self, top: Element, skip: set[int]) -> None:
        """Children, grandchildren and, at any depth, what is in the media namespace. skip: items that lie in a channel."""
        numbers, parents, depths, nths, ups, tags, locals_, texts, wholes = self.nodes
        base = len(numbers)
        self.attrs.add(top.attrs)

        def walk(parent: Element, i: int, depth: int, up: str | None) -> None:
            places: Counter[str] = Counter()
            for child in parent.children:
                if id(child) in skip:
                    continue
                tag = child.tag
                nth = places[tag]
                places[tag] = nth + 1
                me, media = -2, tag.startswith(_MEDIA)
                if (depth <= 2 or media) and (self._media or not media or depth == 1):
                    me = len(numbers) - base
                    local = tag.rsplit("}", 1)[-1] if "}" in tag else tag.split(":", 1)[-1]
                    numbers.append(me)
                    parents.append(i)
                    depths.append(depth)
                    nths.append(nth)
                    ups.append(up)
                    tags.append(tag)
                    locals_.append(local.lower())
                    texts.append(child.text or None)
                    wholes.append(child.serialise() if depth == 1 and local == "content" and child.attrs.get("type") in _MARKUP else None)
                    self.node_attrs.add(child.attrs)
                if child.children:
                    walk(child, me, depth + 1, tag if me >= 0 else None)

        walk(top, -1, 1, None)
        self.offsets.append(len(numbers))

    def cut(self, size: int) -> None:
        """Drops all parts after the first ones."""
        end = self.offsets[size]
        for column in self.nodes:
            del column[end:]
        for maps, keep in ((self.attrs, size), (self.node_attrs, end)):
            del maps.offsets[keep + 1 :], maps.keys[maps.offsets[keep] :], maps.values[maps.offsets[keep] :]
        del self.offsets[size + 1 :]

    def array(self, kind: pa.StructType) -> pa.Array:
        node = kind.field("nodes").type.value_type
        fields = [node.field(k) for k in range(node.num_fields)]
        flat = {n: pa.array(x, pa.int32() if n in ("i", "parent", "depth", "nth") else pa.string()) for n, x in zip(("i", "parent", "depth", "nth", "up", "tag", "local", "text", "whole"), self.nodes)}
        flat["attrs"] = self.node_attrs.array()
        nodes = pa.StructArray.from_arrays([flat[f.name].cast(f.type) for f in fields], fields=fields)
        listed = pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), nodes)
        columns = {"attrs": self.attrs.array(), "nodes": listed}
        outer = [kind.field(k) for k in range(kind.num_fields)]
        return pa.StructArray.from_arrays([columns[f.name].cast(f.type) for f in outer], fields=outer)


def read_document(content: bytes | str | None) -> tuple[str, str | None, bytes, Element, list[Element]]:
    """feed_type, Atom namespace, the bytes that were read, channel and items; Rejected for what is no feed."""
    if content is None:
        raise Rejected("Empty content")
    raw = prepare(encode_text(content) if isinstance(content, str) else content)
    root = read(raw)
    if root is None:
        shown = raw[:500].decode("utf-8", "replace").strip()[:200]
        what = f"received content that couldn't be parsed as XML (first 200 chars: {shown})" if shown else "received empty content"
        raise Rejected(f"Failed to parse XML: {what}")
    reject_other_roots(root, raw)
    kind, space, channel, items = find_feed(root, raw)
    return kind, space, raw, channel, items


class _Batch:
    """The shredded columns of a batch of documents."""

    def __init__(self, with_items: bool, media: bool) -> None:
        self._with_items = with_items
        self.channels, self.items = _Parts(media), _Parts(media)
        self.kinds, self.spaces, self.media, self.errors, self.places, self.ends = [], [], [], [], [], [0]

    def add(self, content: bytes | str | None) -> None:
        done = len(self.channels), len(self.items)
        kind = space = media = place = error = None
        try:
            kind, space, raw, channel, items = read_document(content)
            media, place = b"search.yahoo.com/mrss" in raw, len(self.channels)
            self.channels.add(channel, {id(x) for x in items})
            for item in items if self._with_items else ():
                self.items.add(item, set())
        except Rejected as e:
            error = str(e)
        except RecursionError:
            kind, space, media, place, error = None, None, None, None, "Failed to parse XML: nested too deeply"
            self.channels.cut(done[0])
            self.items.cut(done[1])
        self.kinds.append(kind)
        self.spaces.append(space)
        self.media.append(media)
        self.places.append(place)
        self.errors.append(error and {"class": "ValueError", "message": error})
        self.ends.append(len(self.items))

    def arrays(self, types: dict[str, pa.DataType]) -> dict[str, pa.Array]:
        # a rejected document has neither channel nor items
        starts = [None if p is None else e for p, e in zip(self.places, self.ends)]
        items = pa.ListArray.from_arrays(pa.array([*starts, self.ends[-1]], pa.int32()), self.items.array(types["items"].value_type))
        return {
            "feed_type": pa.array(self.kinds, pa.string()), "atom_ns": pa.array(self.spaces, pa.string()), "has_media": pa.array(self.media, pa.bool_()),
            "channel": self.channels.array(types["channel"]).take(pa.array(self.places, pa.int32())), "items": items.cast(types["items"]), "error": pa.array(self.errors, types["error"]),
        }


def shred(docs: DataFrame, content: str = "content", with_items: bool = True, media: bool = True) -> DataFrame:
    """docs with its content replaced by feed_type, atom_ns, has_media, channel, items and error.

    Narrow: one Arrow-batched pass, no shuffle; errors are values. Rows whose content is null give an error row. media: off,
    nodes below the first level that only media columns read are not made. A document is whole in memory in its worker;
    batches are small, so that large documents don't add up.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    kept = [c for c in docs.columns if c != content]
    schema = StructType([docs.schema[c] for c in kept] + list(StructType.fromDDL(SHREDDED)))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {arrow.field(i).name: arrow.field(i).type for i in range(len(kept), len(arrow))}
        for batch in batches:
            shredded = _Batch(with_items, media)
            for x in batch.column(content):
                shredded.add(x.as_py())
            made = shredded.arrays(types)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(made[n] for n in types)], names=[*kept, *types])

    return docs.select(*kept, content).mapInArrow(run, schema)
