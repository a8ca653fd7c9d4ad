"""Sorting strings with long common prefixes: multikey quicksort to a shallow depth, then blind tries."""

from __future__ import annotations

#: Bytes that are compared as one character by the quicksort, and the depth at which the tries take over.
STEP, SHALLOW = 8, 64


def lcp(a: int, b: int, width: int) -> int:
    """Common prefix of two strings of `width` bytes, given as big-endian integers."""
    return width - ((a ^ b).bit_length() + 7) // 8


class _Trie:
    """A blind trie: inner nodes keep the depth at which their children differ and one byte for each child."""

    __slots__ = ("depth", "children", "leaf")

    def __init__(self, depth: int, leaf: int = -1) -> None:
        self.depth, self.children, self.leaf = depth, {}, leaf


def _blind_trie(items: list[int], strings: list[bytes], numbers: list[int], width: int) -> list[int]:
    """items in order of their strings; equal strings stay in the order given.

    A string goes down by the branching bytes alone, is compared once, whole, with a leaf that it reaches, and takes its
    place on that path at the depth of the difference.
    """
    root, same = _Trie(width, items[0]), {}
    for item in items[1:]:
        s, node = strings[item], root
        while node.leaf < 0:
            node = node.children.get(s[node.depth]) or next(iter(node.children.values()))
        at = lcp(numbers[item], numbers[node.leaf], width)
        if at == width:
            same.setdefault(node.leaf, []).append(item)
            continue
        other = strings[node.leaf][at]
        above, node = None, root
        while node.leaf < 0 and node.depth < at:
            above, node = node, node.children[s[node.depth]]
        if node.leaf < 0 and node.depth == at:
            node.children[s[at]] = _Trie(width, item)
            continue
        split = _Trie(at)
        split.children = {other: node, s[at]: _Trie(width, item)}
        if above is None:
            root = split
        else:
            above.children[s[above.depth]] = split
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.leaf >= 0:
            out += [node.leaf, *same.get(node.leaf, ())]
        else:
            stack += [node.children[b] for b in sorted(node.children, reverse=True)]
    return out


def sort_strings(strings: list[bytes], width: int) -> tuple[list[int], list[int]]:
    """The order of strings that are all `width` bytes long, and each one's common prefix with the one before it in that order."""
    numbers = [int.from_bytes(s, "big") for s in strings]
    if len(strings) == 2:
        order = [0, 1] if numbers[0] <= numbers[1] else [1, 0]
        return order, [0, lcp(*numbers, width)]
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        items, depth = stack.pop()
        if len(items) < 2:
            out += items
            continue
        # what all of them share is stepped over at once
        group = [numbers[i] for i in items]
        depth = max(depth, lcp(min(group), max(group), width) // STEP * STEP)
        if depth >= min(SHALLOW, width):
            out += _blind_trie(items, strings, numbers, width)
            continue
        keys = [strings[i][depth : depth + STEP] for i in items]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less, more = [i for i, k in zip(items, keys) if k < pivot], [i for i, k in zip(items, keys) if k > pivot]
        stack += [(more, depth), ([i for i, k in zip(items, keys) if k == pivot], depth + STEP), (less, depth)]
    return out, [0] + [lcp(numbers[a], numbers[b], width) for a, b in zip(out, out[1:])]


def intervals(prefixes: list[int], least: int) -> list[tuple[int, int, int]]:
    """(depth, first, last) of the maximal runs of a sorted list that share a prefix of that depth, for all depths >= least."""
    out, stack = [], [(0, 0)]
    for i, p in enumerate([*prefixes[1:], -1], 1):
        first = i - 1
        while stack and stack[-1][0] > p:
            depth, first = stack.pop()
            if depth >= least:
                out.append((depth, first, i - 1))
        if not stack or stack[-1][0] < p:
            stack.append((p, first))
    return out
