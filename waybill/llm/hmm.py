"""A hidden Markov model: expected counts of Baum-Welch, and the scaled forward recursion.

Sequences run together, one step at a time: with the longest first, those still running are always the first ones. Tokens are laid
out step by step, so a step reads one stretch of memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states): probability of the symbol in each state


def first_moves(states: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and moves of states that keep to themselves."""
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return np.full(states, 1 / states), move


def first_model(states: int, marginal: np.ndarray, seed: int) -> Model:
    """States that keep to themselves, each with the marginal of the symbols and noise of its own."""
    noise = np.random.default_rng(seed).uniform(0.4, 1.6, (len(marginal), states))
    emit = marginal[:, None] * noise
    return Model(*first_moves(states), emit / emit.sum(axis=0))


def next_moves(start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts and moves that the expected counts call for."""
    start, move = start + 0.5, move + 0.5
    return start / start.sum(), move / move.sum(axis=1, keepdims=True)


def stepwise(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences laid end to end: the order of tokens step by step, where each step begins, and the order
    of the sequences (longest first)."""
    rank = np.argsort(-length, kind="stable")
    ordered = length[rank]
    steps = int(ordered[0]) if len(ordered) else 0
    running = len(ordered) - np.searchsorted(ordered[::-1], np.arange(steps), side="right")
    begin = np.append(0, np.cumsum(running))
    starts = (np.cumsum(length) - length)[rank]
    step = np.repeat(np.arange(steps), running)
    lane = np.arange(len(step)) - begin[step]
    return starts[lane] + step, begin, rank


def expect(model: Model, symbols: np.ndarray, length: np.ndarray, later: np.ndarray | None = None,
           shares: np.ndarray | None = None, emitted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions, and the log likelihood (natural).

    Sequences marked ``later`` go on from the middle of another: they begin with the states' ``shares`` and are no starts. Emissions
    are added to ``emitted`` if given.
    """
    states, kind = len(model.start), np.float32
    order, begin, rank = stepwise(length)
    symbol = symbols[order].astype(np.intp)
    emit = model.emit.astype(kind, copy=False).take(symbol, axis=0)
    real = np.ones(len(length), bool) if later is None else ~later[rank]
    opening = np.where(real[:, None], model.start, model.start if shares is None else shares).astype(kind)
    move, ones = model.move.astype(kind), np.ones(states, kind)
    forward, scale = np.empty_like(emit), np.empty(len(symbol), kind)
    steps = len(begin) - 1
    now = None
    for t in range(steps):
        at = slice(begin[t], begin[t + 1])
        now = emit[at] * (opening if t == 0 else now[:begin[t + 1] - begin[t]] @ move)
        total = now @ ones
        now /= total[:, None]
        forward[at], scale[at] = now, total
    moved = np.zeros((states, states))
    back = None
    for t in range(steps - 1, -1, -1):
        at, n = slice(begin[t], begin[t + 1]), begin[t + 1] - begin[t]
        behind = np.ones((n, states), kind)
        if back is not None:
            moved += forward[at][:len(back)].T @ back
            behind[:len(back)] = back @ move.T
        # What the step before needs; the array then holds the state's probability.
        back = emit[at] * behind / scale[at][:, None]
        forward[at] *= behind
    if emitted is None:
        emitted = np.zeros((len(model.emit), states), order="F")
    for k in range(states):
        emitted[:, k] += np.bincount(symbol, weights=forward[:, k], minlength=len(model.emit))
    started = forward[:begin[1]][real].sum(axis=0, dtype=float) if steps else np.zeros(states)
    return started, moved * model.move, emitted, float(np.log(scale.astype(float)).sum())


def log_likelihood(model: Model, symbols: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The exact natural log of each sequence's probability, by the scaled forward recursion."""
    order, begin, rank = stepwise(length)
    symbol = symbols[order].astype(np.intp)
    total = np.zeros(len(length))
    ones = np.ones(len(model.start))
    now = None
    for t in range(len(begin) - 1):
        emit = model.emit.take(symbol[begin[t]:begin[t + 1]], axis=0)
        now = emit * (model.start if t == 0 else now[:len(emit)] @ model.move)
        scale = now @ ones
        now /= scale[:, None]
        total[:len(emit)] += np.log(scale)
    out = np.empty_like(total)
    out[rank] = total
    return out
