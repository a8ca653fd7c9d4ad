"""A minimal acyclic transducer: sorted words -> sequences of ids, in flat arrays that are mapped into memory."""

from __future__ import annotations

import mmap
import struct
import tempfile

import numpy as np

_MAGIC = b"MAT1"


class Builder:
    """Incremental construction from words in ascending byte order; equal suffixes share their states."""

    def __init__(self) -> None:
        self._register: dict[tuple, int] = {}
        self._states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        #: the states of the last word, not yet in the register: [accepting, edges but the open one, open label]
        self._path: list[list] = [[False, [], None]]
        self._last: bytes | None = None

    def _close(self, depth: int) -> None:
        """Freezes the path below depth; an equal state that exists is used instead."""
        while len(self._path) > depth + 1:
            accepting, edges, _ = self._path.pop()
            state = (accepting, tuple(edges))
            number = self._register.get(state)
            if number is None:
                number = self._register[state] = len(self._states)
                self._states.append(state)
            above = self._path[-1]
            above[1].append((above[2], number))
            above[2] = None

    def add(self, word: bytes) -> None:
        if self._last is not None and word <= self._last:
            raise ValueError("words must ascend")
        shared = 0
        for a, b in zip(word, self._last or b""):
            if a != b:
                break
            shared += 1
        self._close(shared)
        for byte in word[shared:]:
            self._path[-1][2] = byte
            self._path.append([False, [], None])
        self._path[-1][0] = True
        self._last = word

    def finish(self, outputs: list[list[int]]) -> bytes:
        """The automaton with outputs[i] as the ids of the i-th word."""
        self._close(0)
        accepting, edges, _ = self._path[0]
        self._states.append((accepting, tuple(edges)))
        below = [0] * len(self._states)  # words accepted from a state; targets come before their sources
        first, labels, targets, skips = [0], [], [], []
        for number, (final, out) in enumerate(self._states):
            passed = int(final)
            for label, target in out:
                labels.append(label)
                targets.append(target)
                skips.append(passed)
                passed += below[target]
            below[number] = passed
            first.append(len(labels))
        ends = np.cumsum([0, *map(len, outputs)])
        parts = [
            np.array([s[0] for s in self._states], np.uint8), np.array(first, np.int32), np.array(labels, np.uint8), np.array(targets, np.int32),
            np.array(skips, np.int32), ends.astype(np.int32), np.array([i for x in outputs for i in x], np.int32),
        ]
        head, body, at = [], [], len(_MAGIC) + 16 * len(parts)
        for part in parts:
            at += -at % 8
            head.append(struct.pack("<QQ", at, len(part)))
            body.append((at, part.tobytes()))
            at += part.nbytes
        out = bytearray(at)
        out[: len(_MAGIC)] = _MAGIC
        out[len(_MAGIC) : len(_MAGIC) + 16 * len(parts)] = b"".join(head)
        for where, raw in body:
            out[where : where + len(raw)] = raw
        return bytes(out)


class Transducer:
    """The mapped automaton; lookup gives a word's ids, or None."""

    _TYPES = (np.uint8, np.int32, np.uint8, np.int32, np.int32, np.int32, np.int32)

    def __init__(self, raw: bytes) -> None:
        # a file that has no name: the pages are the kernel's, and nothing stays when the worker ends
        with tempfile.TemporaryFile() as f:
            f.write(raw)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self._map[: len(_MAGIC)] != _MAGIC:
            raise ValueError("not a transducer")
        view, self._starts, arrays = memoryview(self._map), [], []
        for i, kind in enumerate(self._TYPES):
            at, n = struct.unpack_from("<QQ", self._map, len(_MAGIC) + 16 * i)
            arrays.append(view[at : at + n * np.dtype(kind).itemsize].cast(np.dtype(kind).char))
            self._starts.append(at)
        self._final, self._first, self._labels, self._targets, self._skips, self._ends, self._ids = arrays
        self.states, self.edges = len(self._final), len(self._labels)

    def lookup(self, word: bytes) -> list[int] | None:
        state, number, base = self.states - 1, 0, self._starts[2]
        first, targets, skips, find = self._first, self._targets, self._skips, self._map.find
        for i in range(len(word)):
            at = find(word[i : i + 1], base + first[state], base + first[state + 1])
            if at < 0:
                return None
            number += skips[at - base]
            state = targets[at - base]
        if not self._final[state]:
            return None
        return self._ids[self._ends[number] : self._ends[number + 1]].tolist()


def compile_words(entries: dict[bytes, list[int]]) -> bytes:
    builder, words = Builder(), sorted(entries)
    for word in words:
        builder.add(word)
    return builder.finish([entries[w] for w in words])
