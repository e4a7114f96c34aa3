"""Character-level bidirectional LSTM with a CRF on top, in numpy: forward, gradient, decoding."""

from __future__ import annotations

import unicodedata

import numpy as np

TYPES = ["EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME"]
#: 0 is outside; type k begins with 1 + 2k and goes on with 2 + 2k.
N_TAGS = 1 + 2 * len(TYPES)
PAD, UNKNOWN, UPPER, LOWER, CYR_UPPER, CYR_LOWER, OTHER_LETTER, SIGN = 0, 1, 2, 3, 4, 5, 6, 7
N_CHARS = 8 + 95 + 1
EMBED, HIDDEN = 24, 48


def char_id(c: str) -> int:
    """Printable ASCII by itself, everything else by its class, so any script has an id."""
    o = ord(c)
    if 32 <= o < 127:
        return 8 + o - 32
    if c == "↵" or c == "\n":
        return 8 + 95
    kind = unicodedata.category(c)
    if 0x400 <= o < 0x530:
        return CYR_UPPER if kind == "Lu" else CYR_LOWER
    if o in (0xFF20,):
        return 8 + ord("@") - 32
    if kind == "Lu":
        return UPPER
    if kind == "Ll":
        return LOWER
    if kind[0] == "L":
        return OTHER_LETTER
    return SIGN if kind[0] in "PSZ" else UNKNOWN


_IDS: dict[str, int] = {}


def encode(text: str) -> list[int]:
    out = []
    for c in text:
        i = _IDS.get(c)
        if i is None:
            i = _IDS[c] = char_id(c)
        out.append(i)
    return out


def init(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def w(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)

    b = np.zeros((2, 4 * HIDDEN), np.float32)
    b[:, HIDDEN : 2 * HIDDEN] = 1
    return {
        "E": (rng.standard_normal((N_CHARS, EMBED)) * 0.3).astype(np.float32),
        "Wx": w(2, EMBED, 4 * HIDDEN), "Wh": w(2, HIDDEN, 4 * HIDDEN), "b": b,
        "Wo": w(2 * HIDDEN, N_TAGS), "bo": np.zeros(N_TAGS, np.float32),
        "A": np.zeros((N_TAGS, N_TAGS), np.float32), "start": np.zeros(N_TAGS, np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(p: dict, ids: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple]:
    """Hidden states (B, T, 2H); the second direction reads from the end."""
    n, t = ids.shape
    h = HIDDEN
    emb = p["E"][ids]  # B T E
    pre = np.empty((t, 2, n, 4 * h), np.float32)
    pre[:, 0] = (emb @ p["Wx"][0] + p["b"][0]).transpose(1, 0, 2)
    pre[:, 1] = (emb[:, ::-1] @ p["Wx"][1] + p["b"][1]).transpose(1, 0, 2)
    hs = np.zeros((t + 1, 2, n, h), np.float32)
    cs = np.zeros((t + 1 if keep else 1, 2, n, h), np.float32)
    c = cs[0]
    for k in range(t):
        g = pre[k]
        g += hs[k] @ p["Wh"]
        g[..., : 3 * h] = _sigmoid(g[..., : 3 * h])
        g[..., 3 * h :] = np.tanh(g[..., 3 * h :])
        c = g[..., h : 2 * h] * c + g[..., :h] * g[..., 3 * h :]
        hs[k + 1] = g[..., 2 * h : 3 * h] * np.tanh(c)
        if keep:
            cs[k + 1] = c
    out = np.concatenate([hs[1:, 0].transpose(1, 0, 2), hs[:0:-1, 1].transpose(1, 0, 2)], axis=2)
    return out, (emb, pre, hs, cs)


def decoder(p: dict) -> dict[str, np.ndarray]:
    """``p`` with weights laid out for :func:`emissions`: one block per gate and direction.

    The input part of a gate is a row per character, and a sigmoid is a tanh of half its argument.
    """
    half = np.array([0.5, 0.5, 0.5, 1], np.float32)[:, None, None]
    by_gate = lambda x: x.reshape(-1, 4, HIDDEN).transpose(1, 0, 2) * half
    inputs = np.stack([by_gate(p["E"] @ p["Wx"][d] + p["b"][d]) for d in (0, 1)])
    # states are kept at twice their value, so that no gate is halved
    gates = np.stack([by_gate(p["Wh"][d]) for d in (0, 1)]) * 0.5
    return p | {"inputs": np.ascontiguousarray(inputs, np.float32), "gates": np.ascontiguousarray(gates, np.float32), "out": p["Wo"] * 0.5}


def emissions(p: dict, ids: np.ndarray) -> np.ndarray:
    """Scores (B, T, tags) of padded windows, from weights of :func:`decoder`."""
    n, t = ids.shape
    g, x = np.empty((2, 4, n, HIDDEN), np.float32), np.empty((2, 4, n, HIDDEN), np.float32)
    c, part = np.zeros((2, n, HIDDEN), np.float32), np.empty((2, n, HIDDEN), np.float32)
    hs = np.zeros((t + 1, 2, n, HIDDEN), np.float32)
    columns = np.ascontiguousarray(ids.T)
    for k in range(t):
        np.matmul(hs[k][:, None], p["gates"], out=g)
        np.take(p["inputs"][0], columns[k], axis=1, out=x[0], mode="clip")
        np.take(p["inputs"][1], columns[t - 1 - k], axis=1, out=x[1], mode="clip")
        g += x
        np.tanh(g, out=g)
        g[:, :3] += 1
        c *= g[:, 1]
        c += np.multiply(g[:, 0], g[:, 3], out=part)
        c *= 0.5
        np.multiply(g[:, 2], np.tanh(c, out=part), out=hs[k + 1])
    both = np.concatenate([hs[1:, 0], hs[:0:-1, 1]], axis=2)
    return np.ascontiguousarray((both @ p["out"] + p["bo"]).transpose(1, 0, 2))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def gradient(p: dict, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of the tag sequences (padding is tagged outside) and its gradient."""
    n, t = ids.shape
    h = HIDDEN
    out, (emb, act, hs, cs) = _lstm(p, ids, True)
    em = out @ p["Wo"] + p["bo"]
    alpha = np.empty((t, n, N_TAGS), np.float32)
    beta = np.zeros((t, n, N_TAGS), np.float32)
    alpha[0] = p["start"] + em[:, 0]
    for k in range(1, t):
        alpha[k] = em[:, k] + _lse(alpha[k - 1][:, :, None] + p["A"], 1)
    for k in range(t - 2, -1, -1):
        beta[k] = _lse(p["A"] + (em[:, k + 1] + beta[k + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    at = np.arange(n)
    gold = p["start"][tags[:, 0]] + np.take_along_axis(em, tags[:, :, None], 2)[..., 0].sum(1)
    gold = gold + p["A"][tags[:, :-1], tags[:, 1:]].sum(1)
    loss = float((z - gold).mean())
    d_em = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2)
    np.add.at(d_em, (at[:, None], np.arange(t)[None], tags), -1)
    d_a = np.zeros_like(p["A"])
    for k in range(1, t):
        pair = alpha[k - 1][:, :, None] + p["A"] + (em[:, k] + beta[k])[:, None, :] - z[:, None, None]
        d_a += np.exp(pair).sum(0)
    np.add.at(d_a, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
    d_em /= n
    g = {"A": d_a / n, "start": d_em[:, 0].sum(0)}
    flat = d_em.reshape(-1, N_TAGS)
    g["Wo"], g["bo"] = out.reshape(-1, 2 * h).T @ flat, flat.sum(0)
    d_out = d_em @ p["Wo"].T
    d_hs = np.stack([d_out[..., :h].transpose(1, 0, 2), d_out[:, ::-1, h:].transpose(1, 0, 2)], 1)  # T 2 B H
    d_pre = np.empty((t, 2, n, 4 * h), np.float32)
    dh = np.zeros((2, n, h), np.float32)
    dc = np.zeros((2, n, h), np.float32)
    wh_t = p["Wh"].transpose(0, 2, 1)
    for k in range(t - 1, -1, -1):
        a, c = act[k], cs[k + 1]
        i, f, o, q = a[..., :h], a[..., h : 2 * h], a[..., 2 * h : 3 * h], a[..., 3 * h :]
        dh = dh + d_hs[k]
        tc = np.tanh(c)
        dc = dc + dh * o * (1 - tc * tc)
        d = d_pre[k]
        d[..., :h] = dc * q * i * (1 - i)
        d[..., h : 2 * h] = dc * cs[k] * f * (1 - f)
        d[..., 2 * h : 3 * h] = dh * tc * o * (1 - o)
        d[..., 3 * h :] = dc * i * (1 - q * q)
        dc = dc * f
        dh = d @ wh_t
    g["b"] = d_pre.sum((0, 2))
    g["Wh"] = np.stack([hs[:-1, j].reshape(-1, h).T @ d_pre[:, j].reshape(-1, 4 * h) for j in (0, 1)])
    fwd = d_pre[:, 0].transpose(1, 0, 2).reshape(-1, 4 * h)
    bwd = d_pre[::-1, 1].transpose(1, 0, 2).reshape(-1, 4 * h)
    flat_emb = emb.reshape(-1, EMBED)
    g["Wx"] = np.stack([flat_emb.T @ fwd, flat_emb.T @ bwd])
    d_emb = fwd @ p["Wx"][0].T + bwd @ p["Wx"][1].T
    g["E"] = np.zeros_like(p["E"])
    np.add.at(g["E"], ids.ravel(), d_emb)
    return loss, g


def plainly_outside(p: dict, em: np.ndarray) -> np.ndarray:
    """Rows whose best path is certain to have no tag, without decoding them in full.

    What a stretch of tags gains over no tag is summed along the text, by the type it has got to, with
    the greatest gain of each kind of transition. Where no stretch ends with a gain, no path with
    tags is the best.
    """
    over = (p["A"] - p["A"][0, 0]).astype(np.float32)
    types = range(1, N_TAGS, 2)
    first, begin, switch = (p["start"] - p["start"][0])[1::2], over[0, 1::2], over[1:, 1::2].max(0)
    on = np.array([over[[j, j + 1], j + 1].max() for j in types], np.float32)
    out = np.array([over[[j, j + 1], 0].max() for j in types], np.float32)
    lead = (em - em[:, :, :1]).transpose(1, 0, 2)
    starts, goes_on = lead[:, :, 1::2], lead[:, :, 2::2] + on
    run = starts[0] + first
    gains = np.zeros(em.shape[0], bool)
    for k in range(1, len(lead)):
        gains |= (run + out >= 0).any(1)
        run = np.maximum(starts[k] + np.maximum(begin, run.max(1)[:, None] + switch), run + goes_on[k])
    return ~(gains | (run >= 0).any(1))


def viterbi(p: dict, em: np.ndarray) -> np.ndarray:
    """Best tag sequences (B, T) under the CRF; a type may only go on where it began."""
    n, t, _ = em.shape
    a = p["A"].copy()
    for k in range(len(TYPES)):
        a[[j for j in range(N_TAGS) if j not in (1 + 2 * k, 2 + 2 * k)], 2 + 2 * k] = -1e4
    score = p["start"] + em[:, 0]
    score[:, 2::2] = -1e4
    back = np.empty((t, n, N_TAGS), np.int8)
    for k in range(1, t):
        s = score[:, :, None] + a
        back[k] = s.argmax(1)
        score = s.max(1) + em[:, k]
    tags = np.empty((n, t), np.int8)
    tags[:, -1] = score.argmax(1)
    rows = np.arange(n)
    for k in range(t - 1, 0, -1):
        tags[:, k - 1] = back[k][rows, tags[:, k]]
    return tags
