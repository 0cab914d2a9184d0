"""Deep-shallow sorting of byte strings inside a task."""

from __future__ import annotations

import numpy as np

SHALLOW = 4     # words of 8 bytes that multikey quicksort looks at
SMALL = 12      # groups up to this size go to a blind trie at once


def deep_shallow(strings: list[bytes]) -> np.ndarray:
    """The order that sorts ``strings``; equal ones in the order given.

    Shallow: multikey quicksort on words of eight bytes, three ways around the median word, moving on to the next word
    only for the equal part. Deep: what still agrees after ``SHALLOW`` words, and every small group, is ordered by a blind
    trie, which reads each string once however long the common prefix is.
    """
    n = len(strings)
    width = 8 * SHALLOW
    padded = b"".join(s[:width].ljust(width, b"\0") for s in strings)
    words = np.frombuffer(padded, ">u8").reshape(n, SHALLOW).astype(np.uint64)
    done: list[int] = []
    stack = [(np.arange(n), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            done.append(int(group[0]))
        elif len(group) <= SMALL or depth == SHALLOW:
            done.extend(blind_trie(strings, group.tolist()))
        else:
            word = words[group, depth]
            pivot = np.partition(word, len(word) // 2)[len(word) // 2]
            low, high = word < pivot, word > pivot
            for part, at in ((high, depth), (~(low | high), depth + 1), (low, depth)):
                if part.any():
                    stack.append((group[part], at))
    return np.array(done, np.int64)


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - (((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) >> 3)


def blind_trie(strings: list[bytes], group: list[int]) -> list[int]:
    """The order of a group of strings by a trie whose edges hold only their first byte and their depth.

    A string goes down by single bytes without looking at the rest, is compared once with the string of the leaf it
    reaches, and is hung in where that comparison ended. A node is [depth, {byte: child}], a leaf a list of equal
    strings; the byte after the end of a string is -1.
    """
    root: list = [len(strings[group[0]]), {-1: [group[0]]}]
    for i in group[1:]:
        text = strings[i]
        node = root
        while True:
            kids = node[1]
            child = kids.get(text[node[0]] if node[0] < len(text) else -1)
            child = next(iter(kids.values())) if child is None else child
            if not isinstance(child[-1], dict):
                break
            node = child
        known = strings[child[0]]
        shared = common_prefix(text, known)
        if shared == len(text) == len(known):
            child.append(i)
            continue
        # Down again to the edge on which the strings part.
        parent, node = None, root
        while node[0] < shared:
            key = known[node[0]]
            child = node[1][key]
            if not isinstance(child[-1], dict):
                break
            parent, node = (node, key), child
        mine = text[shared] if shared < len(text) else -1
        other = known[shared] if shared < len(known) else -1
        if node[0] == shared:
            node[1][mine] = [i]
        elif node[0] > shared:
            split = [shared, {other: node, mine: [i]}]
            if parent is None:
                root = split
            else:
                parent[0][1][parent[1]] = split
        else:
            node[1][key] = [shared, {other: child, mine: [i]}]
    order: list[int] = []
    stack: list = [root]
    while stack:
        node = stack.pop()
        if isinstance(node[-1], dict):
            stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
        else:
            order.extend(node)
    return order


def neighbours(strings: list[bytes], order: np.ndarray) -> np.ndarray:
    """Common prefix of each string in order with the one before it; 0 for the first."""
    width = max(map(len, strings), default=0)
    lengths = np.array([len(s) for s in strings])
    out = np.zeros(len(strings), np.int64)
    step = max(1, (1 << 24) // max(1, width))
    for low in range(1, len(order), step):
        rows = order[low - 1:low + step]
        table = np.frombuffer(b"".join(strings[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
        differ = table[1:] != table[:-1]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[low:low + len(shared)] = np.minimum(shared, np.minimum(lengths[rows[1:]], lengths[rows[:-1]]))
    return out
