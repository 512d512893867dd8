"""Linear-chain conditional random fields: training by the exact likelihood, decoding by Viterbi."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

NEVER = -1e4
#: Steps of a block in best_paths().
BLOCK = 128


class Moves(NamedTuple):
    """Scores of going from one tag to the next, and of beginning with a tag."""

    move: np.ndarray
    begin: np.ndarray


def forbidden(tags: int, moves: list[tuple[int, int]] = (), begins: list[int] = ()) -> Moves:
    """Moves that score 0, but never those given."""
    move, begin = np.zeros((tags, tags)), np.zeros(tags)
    for a, b in moves:
        move[a, b] = NEVER
    begin[list(begins)] = NEVER
    return Moves(move, begin)


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(rows: list[np.ndarray], tags: list[list[int]], start: Moves, steps: int = 80, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, Moves]:
    """(weights: features x tags, moves) by adaptive gradient steps on the regularised log likelihood of all sequences."""
    n, longest, width, k = len(rows), max(len(r) for r in rows), rows[0].shape[1], len(start.begin)
    x, y, mask = np.zeros((n, longest, width)), np.zeros((n, longest), np.int64), np.zeros((n, longest))
    for i, (row, tag) in enumerate(zip(rows, tags, strict=True)):
        x[i, : len(row)], y[i, : len(row)], mask[i, : len(row)] = row, tag, 1
    flat, hot = x.reshape(-1, width), np.eye(k)[y] * mask[..., None]
    pairs = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
    w, a = np.zeros((width, k)), np.zeros((k, k))
    sq_w, sq_a = np.full_like(w, 1e-8), np.full_like(a, 1e-8)
    for _step in range(steps):
        unary, move = (flat @ w).reshape(n, longest, k), a + start.move
        forward, backward = np.empty((n, longest, k)), np.zeros((n, longest, k))
        forward[:, 0] = unary[:, 0] + start.begin
        for t in range(1, longest):
            new = _sum(forward[:, t - 1, :, None] + move, 1) + unary[:, t]
            forward[:, t] = np.where(mask[:, t, None] > 0, new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _sum(move + (unary[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None] > 0, new, backward[:, t + 1])
        whole = _sum(forward[:, -1], 1)
        node = np.exp(forward + backward - whole[:, None, None]) * mask[..., None]
        edge = np.exp(forward[:, :-1, :, None] + move + (unary[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * mask[:, 1:, None, None]
        grad_w = flat.T @ (hot - node).reshape(-1, k) / n - ridge * w
        grad_a = (pairs - edge.sum((0, 1))) / n - ridge * a
        sq_w += grad_w**2
        sq_a += grad_a**2
        w += rate * grad_w / np.sqrt(sq_w)
        a += rate * grad_a / np.sqrt(sq_a)
    return w, Moves(a + start.move, start.begin)


def viterbi(unary: np.ndarray, moves: Moves) -> list[int]:
    """The best path of tags; ties go to the smaller tag."""
    best, back = unary[0] + moves.begin, []
    for row in unary[1:]:
        every = best[:, None] + moves.move
        back.append(every.argmax(0))
        best = every.max(0) + row
    tag = int(best.argmax())
    path = [tag]
    for row in reversed(back):
        tag = int(row[tag])
        path.append(tag)
    return path[::-1]


def best_paths(unary: np.ndarray, moves: Moves) -> np.ndarray:
    """viterbi() over a long row of tokens that begins with one tagged 0, by blocks: all blocks at a time, for each tag before them."""
    n, k = unary.shape
    m = -(-n // BLOCK)
    padded = np.full((m * BLOCK, k), NEVER)
    padded[:, 0] = 0
    padded[:n] = unary
    steps = padded.reshape(m, BLOCK, k)
    back = np.empty((BLOCK, m, k, k), np.uint8)  # step, block, tag before the block, tag -> tag of the step before
    best = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(m, 0)
    for t in range(BLOCK):
        every = best[:, :, :, None] + moves.move
        back[t] = every.argmax(2)
        best = every.max(2) + steps[:, t, None, :]
    # Chain the blocks: scores of the tags after each one, and from which tag before it they come.
    score, source = np.where(np.arange(k) == 0, 0.0, NEVER), np.empty((m, k), np.int64)
    for i in range(m):
        every = score[:, None] + best[i]
        source[i] = every.argmax(0)
        score = every.max(0) - every.max()
    last, first = np.empty(m, np.int64), np.empty(m, np.int64)
    tag = int(score.argmax())
    for i in range(m - 1, -1, -1):
        last[i] = tag
        first[i] = tag = int(source[i, tag])
    out, rows, now = np.empty((m, BLOCK), np.int64), np.arange(m), last
    for t in range(BLOCK - 1, -1, -1):
        out[:, t] = now
        now = back[t, rows, first, now].astype(np.int64)
    return out.reshape(-1)[:n]
