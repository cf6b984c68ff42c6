"""Double-array trie over bytes, walked by numpy for many positions at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class DoubleArray:
    """``base[state] + byte`` is the next state if ``check`` there names ``state``; state 0 is the root."""

    base: np.ndarray
    check: np.ndarray
    key: np.ndarray  # number of the key that ends in the state, or -1

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and where there is one."""
        to = self.base[state] + byte
        return to, self.check[to] == state


def trie(keys: list[bytes]) -> tuple[list[dict[int, int]], list[int]]:
    """Children of each node, and the number of the key that ends there (-1 if none)."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for number, key in enumerate(keys):
        node = 0
        for byte in key:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][byte]
        ends[node] = number
    return children, ends


def double_array(children: list[dict[int, int]], ends: list[int]) -> tuple[DoubleArray, np.ndarray]:
    """The compact trie, and the state of each node.

    Nodes with several children are placed first, each behind the start of the
    one before; nodes with one child then fill the holes.
    """
    used = bytearray(4 * len(children) + 2048)
    base = np.zeros(len(children), np.int64)
    wide = hole = 257  # a first child at 257 or later keeps every base positive
    for node in sorted(range(len(children)), key=lambda n: -len(children[n])):
        codes = sorted(children[node])
        if not codes:
            break
        if len(codes) == 1:
            while used[hole]:
                hole += 1
            at = hole
        else:
            at = wide
            while any(used[at - codes[0] + c] for c in codes):
                at += 1
            wide = at
        base[node] = at - codes[0]
        if at + 1024 > len(used):
            used.extend(bytes(len(used)))
        for c in codes:
            used[base[node] + c] = 1
    state = np.zeros(len(children), np.int64)
    for node, kids in enumerate(children):
        for byte, kid in kids.items():
            state[kid] = base[node] + byte
    last = len(used) + 256
    out = DoubleArray(np.zeros(last, np.int32), np.full(last, -1, np.int32), np.full(last, -1, np.int32))
    out.base[state] = base
    out.key[state] = ends
    for node, kids in enumerate(children):
        for kid in kids.values():
            out.check[state[kid]] = state[node]
    return out, state
