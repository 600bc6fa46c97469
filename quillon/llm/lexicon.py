"""A minimal acyclic transducer from words to token ids.

Words are added in sorted order; a state whose words are complete is replaced by an equal one met before, so
suffixes are shared. Each edge carries how many words sort before those behind it; the sum along a path is the
word's rank, which points to its ids. States, edges and ids are plain arrays in one file, which workers map
into memory; a whole array of words is looked up in as many steps as the longest has bytes.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass
class Lexicon:
    key: np.ndarray  # state * 256 + byte, sorted
    target: np.ndarray
    add: np.ndarray
    final: np.ndarray
    start: np.ndarray  # of each word's ids, by rank
    ids: np.ndarray

    @staticmethod
    def build(words: dict[bytes, list[int]]) -> Lexicon:
        """words without the empty one; an empty dictionary gives a lexicon that knows nothing."""
        order = sorted(words)
        edges: list[dict[int, int]] = [{}]
        final: list[bool] = [False]
        known: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []  # (parent, byte, child) not yet minimised

        def close(down: int) -> None:
            while len(path) > down:
                parent, byte, child = path.pop()
                signature = (final[child], *edges[child].items())
                same = known.setdefault(signature, child)
                edges[parent][byte] = same

        last = b""
        for w in order:
            common = 0
            top = min(len(w), len(last))
            while common < top and w[common] == last[common]:
                common += 1
            close(common)
            node = path[-1][2] if path else 0
            for byte in w[common:]:
                edges.append({})
                final.append(False)
                child = len(edges) - 1
                edges[node][byte] = child
                path.append((node, byte, child))
                node = child
            final[node] = True
            last = w
        close(0)
        # reachable states only, numbered anew; words behind each state
        states = [0]
        number = {0: 0}
        for s in states:
            for t in edges[s].values():
                if t not in number:
                    number[t] = len(states)
                    states.append(t)
        behind: dict[int, int] = {}

        def words_behind(s: int) -> int:
            stack = [s]
            while stack:
                x = stack[-1]
                todo = [t for t in edges[x].values() if t not in behind]
                if todo:
                    stack += todo
                else:
                    behind[x] = final[x] + sum(behind[t] for t in edges[x].values())
                    stack.pop()
            return behind[s]

        words_behind(0)
        rows = []
        for s in states:
            before = int(final[s])
            for byte in sorted(edges[s]):
                t = edges[s][byte]
                rows.append((number[s] * 256 + byte, number[t], before))
                before += behind[t]
        rows.sort()
        key, target, add = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        size = np.array([len(words[w]) for w in order], np.int64)
        return Lexicon(key, target, add, np.array([final[s] for s in states], np.int64), np.r_[0, np.cumsum(size)].astype(np.int64),
                       np.array([i for w in order for i in words[w]], np.int64))

    def rank(self, words: pa.StringArray) -> np.ndarray:
        """Rank of each word, -1 if it isn't in the lexicon."""
        n = len(words)
        if not n or not len(self.key):
            return np.full(n, -1)
        offsets = np.frombuffer(words.buffers()[1], np.int32, n + 1, words.offset * 4).astype(np.int64)
        raw = np.frombuffer(words.buffers()[2], np.uint8)
        size = np.diff(offsets)
        state, rank = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.arange(n)
        out = np.full(n, -1)
        step = 0
        while len(live):
            ended = size[live] == step
            done = live[ended]
            good = done[self.final[state[done]] == 1]
            out[good] = rank[good]
            live = live[~ended]
            k = state[live] * 256 + raw[offsets[live] + step]
            at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
            hit = self.key[at] == k
            live, at = live[hit], at[hit]
            state[live] = self.target[at]
            rank[live] += self.add[at]
            step += 1
        return out

    FIELDS = ("key", "target", "add", "final", "start", "ids")

    def dump(self) -> bytes:
        """One array: a header of sizes, then all fields."""
        parts = [getattr(self, f) for f in self.FIELDS]
        sink = io.BytesIO()
        np.save(sink, np.concatenate([np.array([len(p) for p in parts], np.int64), *parts]))
        return sink.getvalue()

    @staticmethod
    def of(flat: np.ndarray) -> Lexicon:
        ends = np.cumsum(flat[:len(Lexicon.FIELDS)]) + len(Lexicon.FIELDS)
        begin = np.r_[len(Lexicon.FIELDS), ends[:-1]]
        return Lexicon(*(flat[s:e] for s, e in zip(begin.tolist(), ends.tolist())))
