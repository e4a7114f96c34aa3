"""Trains the tagger of personal information: ``python -m siltbed.llm.pii_train [steps]``.

Eight processes each turn fresh labelled texts into a gradient; Adam steps on their mean.
"""

from __future__ import annotations

import os
import sys
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

import multiprocessing as mp  # noqa: E402

import numpy as np  # noqa: E402

from siltbed.llm import tagger as M  # noqa: E402
from siltbed.llm.pii_examples import Examples  # noqa: E402

WORKERS, BATCH = 8, 56
PATH = os.path.join(os.path.dirname(__file__), "models", "pii_tagger.npz")


def batch(seed: int, size: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    ex = Examples(seed)
    rows = [ex.example() for _ in range(size)]
    width = max(8, max(len(t) for t, _ in rows) + ex.r.randint(1, 12))
    ids, tags = np.zeros((size, width), np.int64), np.zeros((size, width), np.int64)
    for i, (text, spans) in enumerate(rows):
        ids[i, : len(text)] = M.encode(text)
        for a, b, kind in spans:
            k = M.TYPES.index(kind)
            tags[i, a:b] = 2 + 2 * k
            tags[i, a] = 1 + 2 * k
    return ids, tags


def _work(job: tuple) -> tuple[float, dict]:
    p, seed = job
    return M.gradient(p, *batch(seed))


def train(steps: int, seed: int = 11, seconds: float = 1e9, start: dict | None = None) -> dict[str, np.ndarray]:
    """Weights after so many steps or seconds, averaged over the last fifth; ``start``: go on from these."""
    p = M.init(seed) if start is None else start
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    average, began = None, time.time()
    with mp.get_context("fork").Pool(WORKERS) as pool:
        for step in range(1, steps + 1):
            done = pool.map(_work, [(p, seed * 10**6 + step * WORKERS + w) for w in range(WORKERS)], chunksize=1)
            g = {k: sum(d[1][k] for d in done) / WORKERS for k in p}
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            part = max(step / steps, (time.time() - began) / seconds)
            rate = 6e-3 * min(1, step / 50) * max(0.02, 0.5 * (1 + np.cos(np.pi * min(1, part))))
            for k in p:
                x = g[k] * min(1, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            if step % 100 == 0:
                print(step, round(float(np.mean([d[0] for d in done])), 3), round(time.time() - began), flush=True)
            if part > 0.8:
                average = {k: x.copy() for k, x in p.items()} if average is None else {k: 0.98 * average[k] + 0.02 * p[k] for k in p}
            if part >= 1:
                break
    return {k: x.astype(np.float32) for k, x in (average or p).items()}


if __name__ == "__main__":
    old = None
    if len(sys.argv) > 3:  # a third argument: the seed, to go on from the stored weights
        with np.load(PATH) as z:
            old = {k: z[k].astype(np.float32) for k in z.files}
    weights = train(int(sys.argv[1]) if len(sys.argv) > 1 else 4000, seconds=float(sys.argv[2]) if len(sys.argv) > 2 else 1e9, seed=int(sys.argv[3]) if old else 11, start=old)
    np.savez_compressed(PATH, **{k: x.astype(np.float16) for k, x in weights.items()})
