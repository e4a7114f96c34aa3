"""Prediction by partial matching: byte contexts of variable order with escapes, under frozen counts.

A byte that followed its longest context in training costs ``-log2(c / (n + d))`` bits (``c`` times
of ``n``, ``d`` different bytes); otherwise the escape costs ``-log2(d / (n + d))`` and the next shorter
context is asked, down to 8 bits for a byte never seen. All languages are kept side by side: one
search finds the row with the exact code length of a byte under every language.
"""

from __future__ import annotations

import numpy as np

ORDER = 5
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _contexts(data: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit value of the ``order`` bytes before each byte (exact up to order 7); the text starts after blanks."""
    padded = np.concatenate([np.full(ORDER, 32, np.uint8), data]).astype(np.uint64)
    h = np.zeros(len(data), np.uint64)
    for k in range(order, 0, -1):
        h = h * np.uint64(256) + padded[ORDER - k : ORDER - k + len(data)]
    return h


class Model:
    """Frozen statistics of several languages; ``costs`` gives bits per byte and language."""

    def __init__(self, texts: dict[str, bytes]) -> None:
        self.langs = sorted(texts)
        n_langs = len(self.langs)
        data = [np.frombuffer(texts[x], np.uint8) for x in self.langs]
        below_keys, below = np.arange(256, dtype=np.uint64), np.full((256, n_langs), 8.0, np.float32)
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for order in range(ORDER + 1):
            counted = []
            for d in data:
                ctx = _contexts(d, order)
                sym, c = np.unique(ctx * np.uint64(256) + d, return_counts=True)
                of, first, different = np.unique(sym // np.uint64(256), return_index=True, return_counts=True)
                total = np.add.reduceat(c, first) if len(c) else c
                counted.append((sym, c, of, total, different))
            keys = np.unique(np.concatenate([x[0] for x in counted]))
            contexts = np.unique(np.concatenate([x[2] for x in counted]))
            escape = np.zeros((len(contexts), n_langs), np.float32)
            for j, (_, _, of, total, different) in enumerate(counted):
                escape[np.searchsorted(contexts, of), j] = -np.log2(different / (total + different))
            # the cost one order down, of every key of this order
            cost = escape[np.searchsorted(contexts, keys // np.uint64(256))]
            low = keys % np.uint64(256) if order == 0 else keys % np.uint64(256 ** max(order, 1))
            cost = cost + below[np.searchsorted(below_keys, low)]
            for j, (sym, c, of, total, different) in enumerate(counted):
                at = np.searchsorted(of, sym // np.uint64(256))
                cost[np.searchsorted(keys, sym), j] = -np.log2(c / (total[at] + different[at]))
            self.orders.append((keys, cost, contexts, escape))
            below_keys, below = keys, cost
        self.base = np.float32(8.0)

    def costs(self, data: np.ndarray) -> np.ndarray:
        """Bits (bytes x languages) of a stretch of bytes."""
        out = np.zeros((len(data), len(self.langs)), np.float32)
        open_ = np.arange(len(data))
        for order in range(ORDER, -1, -1):
            if not len(open_):
                break
            keys, cost, contexts, escape = self.orders[order]
            ctx = _contexts(data, order)[open_]
            want = ctx * np.uint64(256) + data[open_]
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = keys[at] == want
            out[open_[hit]] += cost[at[hit]]
            rest, ctx = open_[~hit], ctx[~hit]
            at = np.minimum(np.searchsorted(contexts, ctx), len(contexts) - 1)
            known = contexts[at] == ctx
            out[rest[known]] += escape[at[known]]
            open_ = rest
        out[open_] += self.base
        return out
