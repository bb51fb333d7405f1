"""A minimal acyclic transducer: words to numbers, with suffixes shared, in one file that is memory-mapped.

The automaton is built from sorted words one after another; a state that can't change any more is merged with an equal one.  Each
transition carries how many words come before those behind it, so the sum along a word's path is the word's place in the sorted
list; that place picks the word's output, a run of token ids.  Look-ups walk many words at once.
"""

from __future__ import annotations

import mmap

import numpy as np

MAGIC = b"GLMAT001"


def build(words: list[bytes], outputs: list[list[int]]) -> bytes:
    """The file for sorted distinct words and their outputs."""
    assert all(a < b for a, b in zip(words, words[1:]))
    labels: list[list[int]] = [[]]
    targets: list[list[int]] = [[]]
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]  # states of the last word's path, which are still open

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            key = (final[state], tuple(labels[state]), tuple(targets[state]))
            same = register.setdefault(key, state)
            if same != state:
                targets[path[-1]][-1] = same

    before = b""
    for word in words:
        common = 0
        while common < min(len(word), len(before)) and word[common] == before[common]:
            common += 1
        close(common)
        for c in word[common:]:
            labels.append([])
            targets.append([])
            final.append(False)
            labels[path[-1]].append(c)
            targets[path[-1]].append(len(labels) - 1)
            path.append(len(labels) - 1)
        final[path[-1]] = True
        before = word
    close(0)
    live, order, number = [0], [], {0: 0}
    while live:
        state = live.pop()
        order.append(state)
        for t in targets[state]:
            if t not in number:
                number[t] = len(number)
                live.append(t)
    below: dict[int, int] = {}

    def count(root: int) -> None:  # words from each state, without recursion
        stack = [root]
        while stack:
            state = stack[-1]
            todo = [t for t in targets[state] if t not in below]
            if todo:
                stack += todo
            else:
                below[state] = final[state] + sum(below[t] for t in targets[state])
                stack.pop()

    count(0)
    keys, to, weight = [], [], []
    for state in order:
        passed = int(final[state])
        for c, t in zip(labels[state], targets[state], strict=True):
            keys.append(number[state] * 256 + c)
            to.append(number[t])
            weight.append(passed)
            passed += below[t]
    by = np.argsort(np.array(keys, np.int64))
    ends = np.zeros(len(number), np.uint8)
    for state, k in number.items():
        ends[k] = final[state]
    starts = np.concatenate([[0], np.cumsum([len(o) for o in outputs], dtype=np.int64)])
    parts = [
        np.array(keys, np.int64)[by],
        np.array(to, np.int32)[by],
        np.array(weight, np.int32)[by],
        ends,
        starts.astype(np.int64),
        np.array([i for o in outputs for i in o], np.uint32),
    ]
    head = np.array([len(p) for p in parts], np.int64).tobytes()
    return MAGIC + head + b"".join(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)


class Transducer:
    """Look-ups in the mapped file; processes of one machine share its pages."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:8] != MAGIC:
            raise ValueError(f"{path}: not a transducer")
        sizes = np.frombuffer(self.map, np.int64, 6, 8)
        at, parts = 8 + 48, []
        for n, kind in zip(sizes, (np.int64, np.int32, np.int32, np.uint8, np.int64, np.uint32), strict=True):
            parts.append(np.frombuffer(self.map, kind, int(n), at))
            at += -(-parts[-1].nbytes // 8) * 8
        self.keys, self.to, self.weight, self.ends, self.starts, self.ids = parts

    def __len__(self) -> int:
        return len(self.starts) - 1

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the lexicon, -1 if it isn't there."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        text = np.frombuffer(b"".join(words), np.uint8)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if n else sizes
        state, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live, depth = np.arange(n), 0
        out = np.full(n, -1, np.int64)
        while len(live):
            done = sizes[live] == depth
            over = live[done]
            over = over[self.ends[state[over]] == 1]
            out[over] = place[over]
            live = live[~done]
            if not len(live) or not len(self.keys):
                break
            key = state[live] * 256 + text[first[live] + depth]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[k] == key
            live, k = live[found], k[found]
            state[live] = self.to[k]
            place[live] += self.weight[k]
            depth += 1
        return out

    def output(self, place: int) -> bytes:
        """The word's ids as little-endian 32-bit numbers."""
        return self.ids[self.starts[place] : self.starts[place + 1]].astype("<u4").tobytes()
