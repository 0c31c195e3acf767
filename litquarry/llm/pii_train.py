"""Fits the tagger: ``python -m litquarry.llm.pii_train SF_DIR OUT.npz [minutes] [START.npz]``; START goes on from earlier weights.

Labelled windows come from at most ``MAX_ROWS`` documents, whose spans are found by cue phrases (``pii_silver``), and from ``MADE``
made texts (``pii_made``) with invented values. A tenth of the documents and a fifth of the made contexts, whole phrases, are held
out and scored by exact start and type. The score on documents is agreement with the cue phrases, not truth.
"""

from __future__ import annotations

import multiprocessing
import re
import sys
import time
from pathlib import Path

import numpy as np
import pandas as pd

from .pii_made import made
from .pii_net import TAGS, TYPES, Tagger, char_ids, codes
from .pii_silver import spans

MAX_ROWS = 10_000
MADE = 24_000
LENGTH = 128


def tags_of(text: str, found) -> np.ndarray:
    y = np.zeros(len(text), dtype=np.int8)
    for a, b, kind in found:
        y[a:b] = TAGS.index(f"I-{kind}")
        y[a] = TAGS.index(f"B-{kind}")
    return y


def windows(labelled, seed: int = 3, per_span: int = 3, plain: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Windows around every labelled span at random offsets, and others anywhere in the texts, of pairs of text and spans."""
    r, table, xs, ys = np.random.default_rng(seed), char_ids(), [], []
    for text, found in labelled:
        x, y = table[codes(text)], tags_of(text, found)
        starts = [max(0, a - int(r.integers(4, LENGTH - 24))) for a, _, _ in found for _ in range(per_span)]
        starts += [int(r.integers(0, max(1, len(text) - LENGTH // 2))) for _ in range(plain)]
        for s in starts:
            wx, wy = x[s : s + LENGTH], y[s : s + LENGTH].copy()
            k = 0  # a span cut by the left edge is labelled as far as it shows
            if k < len(wy) and TAGS[wy[k]][0] == "I":
                while k < len(wy) and TAGS[wy[k]][0] == "I":
                    wy[k] = 0
                    k += 1
            pad = LENGTH - len(wx)
            xs.append(np.pad(wx, (0, pad), constant_values=10))
            ys.append(np.pad(wy, (0, pad)))
    return np.array(xs), np.array(ys).astype(np.int64)


def _worker(pipe, xs, ys):
    net = Tagger()
    while (job := pipe.recv()) is not None:
        net.p, idx = job
        pipe.send(net.loss_and_grads(xs[idx].T, ys[idx].T))


def fit(net: Tagger, xs, ys, epochs: int, batch: int, rate: float, deadline: float, workers: int = 6, seed: int = 1) -> None:
    """Adam on gradients that several processes compute on their shares of each batch."""
    fork = multiprocessing.get_context("fork")
    pipes = []
    for _ in range(workers):
        here, there = fork.Pipe()
        fork.Process(target=_worker, args=(there, xs, ys), daemon=True).start()
        pipes.append(here)
    r = np.random.default_rng(seed)
    m, v, k, steps = {a: np.zeros_like(b) for a, b in net.p.items()}, {a: np.zeros_like(b) for a, b in net.p.items()}, 0, epochs * (len(xs) // batch)
    for e in range(epochs):
        order, total, done = r.permutation(len(xs)), 0.0, 0
        for a in range(0, len(order) - batch + 1, batch):
            for pipe, idx in zip(pipes, np.array_split(order[a : a + batch], workers)):
                pipe.send((net.p, idx))
            got = [pipe.recv() for pipe in pipes]
            total, done = total + sum(x for x, _ in got) / workers, done + 1
            g = {n: sum(d[n] for _, d in got) / workers for n in net.p}
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            k += 1
            lr = rate * 0.5 * (1 + np.cos(np.pi * min(1, k / steps))) + 2e-5
            for n, x in g.items():
                x = x * min(1.0, 5.0 / (norm + 1e-9))
                m[n], v[n] = 0.9 * m[n] + 0.1 * x, 0.999 * v[n] + 0.001 * x * x
                net.p[n] = net.p[n] - (lr * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
        print(f"epoch {e}: loss {total / max(1, done):.4f}", flush=True)
        if time.time() > deadline:
            break
    for pipe in pipes:
        pipe.send(None)


def scores(labelled, net: Tagger) -> dict[str, tuple[float, float, int]]:
    """Precision, recall and number of true spans of each type, by exact start and type."""
    from .pii import find_spans

    out = {}
    found = find_spans([t for t, _ in labelled], net)
    for kind in TYPES:
        true = {(i, a) for i, (_, f) in enumerate(labelled) for a, _, k in f if k == kind}
        got = {(i, a) for i, f in enumerate(found) for a, _, k in f if k == kind}
        out[kind] = (round(len(true & got) / max(1, len(got)), 4), round(len(true & got) / max(1, len(true)), 4), len(true))
    return out


def main(sf_dir: str, out: str, minutes: float = 15, start: str | None = None) -> None:
    texts = [t for t in pd.read_parquet(f"{sf_dir}/documents.parquet", columns=["text"])["text"].head(MAX_ROWS) if t]
    r = np.random.default_rng(0)
    held = set(r.choice(len(texts), len(texts) // 10, replace=False).tolist())
    labelled = [(t, spans(t)) for t in texts]
    train = [x for i, x in enumerate(labelled) if i not in held]
    # Pieces without labelled values, which made sentences stand between.
    fillers = [s for t, f in train if not f for s in re.split(r"(?<=[.!?。])\s+|\n", t) if 20 < len(s) < 160][:20_000]
    more = made(np.random.default_rng(7), MADE, fillers)
    a, b = windows(train, seed=11, per_span=6, plain=2), windows(more, seed=12, per_span=1, plain=0)
    xs, ys = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    print(len(a[0]), len(b[0]), "windows", flush=True)
    net = Tagger.load(Path(start).read_bytes()) if start else Tagger()
    fit(net, xs, ys, epochs=12, batch=384, rate=2.5e-3 if start else 5e-3, deadline=time.time() + 60 * minutes)
    Path(out).write_bytes(net.dump())
    print("documents", scores([labelled[i] for i in sorted(held)], net))
    print("held-out contexts", scores(made(np.random.default_rng(8), 2000, fillers, held=True), net))


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], *map(float, sys.argv[3:4]), *sys.argv[4:5])
