"""A bidirectional gated recurrent network with attention pooling over windows of words, in numpy. Words are known by themselves and by their characters."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np

#: Sizes: inputs, states of one direction, attention; buckets of character n-grams; words of a window and from one window's start to the next.
INPUT, STATE, ATTEND, BUCKETS, WINDOW, STRIDE = 16, 8, 8, 1 << 14, 64, 32
#: Lengths in bytes of character n-grams, taken with the word's edges.
GRAMS = (3, 4, 5, 6)
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return WORD.findall((text or "").lower())


class Grams(NamedTuple):
    """Buckets of all words' n-grams one after the other, where each word's begin, and how many it has."""

    buckets: np.ndarray
    starts: np.ndarray
    counts: np.ndarray


def grams(words: list[str]) -> Grams:
    """Hashed character n-grams of words, worked out for all of them at once over their joined bytes."""
    parts = [f"<{w}>".encode("utf-8", "replace") for w in words]
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    owner = np.repeat(np.arange(len(parts)), np.diff(ends, prepend=0))
    left = ends[owner] - np.arange(len(raw))  # bytes to the word's end
    size = np.diff(ends, prepend=0)
    each = [np.maximum(size - n + 1, 0) for n in GRAMS]
    counts = sum(each, np.zeros(len(parts), np.int64))
    starts = np.cumsum(counts) - counts
    out, place = np.empty(counts.sum(), np.int64), starts.copy()
    for n, own in zip(GRAMS, each, strict=True):
        value = np.zeros(len(raw), np.uint64)
        for k in range(n):
            value[: len(raw) - k] = value[: len(raw) - k] * np.uint64(1099511628211) + raw[k:] + np.uint64(n)
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        good = np.flatnonzero(left >= n)
        whose = owner[good]
        out[place[whose] + size[whose] - left[good]] = (value[good] >> np.uint64(40)).astype(np.int64) % BUCKETS
        place += own
    return Grams(out, starts, counts)


def window_starts(n: int) -> range:
    """Starts of the overlapping windows of n words; the last one reaches the end. A text without words has none."""
    return range(0, max(n - WINDOW + STRIDE, STRIDE) if n else 0, STRIDE)


class Network:
    """Parameters by name, and the words known by themselves."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 11):
        draw = np.random.default_rng(seed)
        normal = lambda *shape, by: (draw.standard_normal(shape) * by).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {
            "words": normal(len(vocabulary) + 1, INPUT, by=0.05), "chars": normal(BUCKETS, INPUT, by=0.05),
            "input": normal(2, INPUT, 3 * STATE, by=INPUT**-0.5), "bias": np.zeros((2, 1, 3 * STATE), np.float32), "state": normal(2, STATE, 3 * STATE, by=STATE**-0.5), "inner": np.zeros((2, 1, STATE), np.float32),
            "attend": normal(2 * STATE, ATTEND, by=(2 * STATE) ** -0.5), "attend_bias": np.zeros(ATTEND, np.float32), "query": normal(ATTEND, by=ATTEND**-0.5), "out": normal(2 * STATE, by=(2 * STATE) ** -0.5), "out_bias": np.zeros(1, np.float32),
        }

    def inputs(self, ids: np.ndarray, g: Grams, drop: np.ndarray | None = None) -> np.ndarray:
        """Input vectors of words: their own, but where dropped, and the mean of their n-grams'."""
        sums = np.add.reduceat(self.p["chars"][g.buckets], g.starts, axis=0) if len(g.starts) else np.zeros((0, INPUT), np.float32)
        own = self.p["words"][ids]
        return sums / np.sqrt(g.counts[:, None]).astype(np.float32) + (own if drop is None else own * drop[:, None])

    def forward(self, x: np.ndarray, at: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logit of each window. x: inputs of the words that occur; at: windows by places, -1 past the end. keep: gets what backward needs.

        Arrays have states before windows, so that each operation runs along many windows.
        """
        p, (n, long) = self.p, at.shape
        projected = np.concatenate([x @ p["input"] + p["bias"], np.zeros((2, 1, 3 * STATE), np.float32)], axis=1)
        there = np.ascontiguousarray((at >= 0).astype(np.float32).T)
        places, inner_bias, across = np.ascontiguousarray(at.T), p["inner"].transpose(0, 2, 1), np.ascontiguousarray(p["state"].transpose(0, 2, 1))
        h, states, steps = np.zeros((2, STATE, n), projected.dtype), np.empty((long, 2 * STATE, n), projected.dtype), []
        given = np.empty((2, 3 * STATE, n), projected.dtype)
        for t in range(long):
            # the second direction reads from the end; padding before its first word leaves its state at zero
            given[0], given[1] = projected[0][places[t]].T, projected[1][places[long - 1 - t]].T
            m = np.stack([there[t], there[long - 1 - t]])[:, None, :]
            own = across @ h
            gates = given[:, : 2 * STATE] + own[:, : 2 * STATE]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:, :STATE], gates[:, STATE:]
            inner = own[:, 2 * STATE :] + inner_bias
            fresh = r * inner
            fresh += given[:, 2 * STATE :]
            np.tanh(fresh, out=fresh)
            if keep is not None:
                steps.append((h, z, r, inner, fresh, m))
            move = fresh - h
            move *= 1 - z
            move *= m
            h = h + move
            states[t, :STATE], states[long - 1 - t, STATE:] = h[0], h[1]
        looked = p["attend"].T @ states
        looked += p["attend_bias"][:, None]
        np.tanh(looked, out=looked)
        weight = p["query"] @ looked + (there - 1) * 1e4
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tsn->sn", weight, states)
        if keep is not None:
            keep += [steps, states, looked, weight, pooled]
        return p["out"] @ pooled + p["out_bias"][0]

    def backward(self, x: np.ndarray, at: np.ndarray, kept: list, error: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of all parameters but words and chars, and of x, for the error of each window's logit."""
        p, (n, long) = self.p, at.shape
        steps, states, looked, weight, pooled = kept
        g = {"out": pooled @ error, "out_bias": error.sum(keepdims=True)}
        d_pooled = p["out"][:, None] * error
        d_weight = np.einsum("tsn,sn->tn", states, d_pooled)
        d_states = weight[:, None, :] * d_pooled
        d_weight = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["query"] = np.einsum("tan,tn->a", looked, d_weight)
        d_looked = d_weight[:, None, :] * p["query"][:, None] * (1 - looked * looked)
        g["attend"], g["attend_bias"] = np.tensordot(states, d_looked, ([0, 2], [0, 2])), d_looked.sum(axis=(0, 2))
        d_states += p["attend"] @ d_looked
        d_h, g["state"], inner_sum = np.zeros((2, STATE, n), states.dtype), np.zeros_like(p["state"]), np.zeros((2, STATE), states.dtype)
        d_given = np.empty((2, 3 * STATE, long, n), states.dtype)  # the second direction's steps from the end, as it reads
        for t in reversed(range(long)):
            h, z, r, inner, fresh, m = steps[t]
            d_h[0] += d_states[t, :STATE]
            d_h[1] += d_states[long - 1 - t, STATE:]
            d_new = d_h * m
            d_move = d_new * (1 - z)
            d_fresh = d_move * (1 - fresh * fresh)
            d_own = np.concatenate([d_new * (h - fresh) * z * (1 - z), d_fresh * inner * r * (1 - r), d_fresh * r], axis=1)
            inner_sum += d_own[:, 2 * STATE :].sum(axis=2)
            g["state"] += h @ d_own.transpose(0, 2, 1)
            d_given[:, :, t] = d_own
            d_given[:, 2 * STATE :, t] = d_fresh
            d_h = d_h - d_move + p["state"] @ d_own
        g["inner"], g["bias"] = inner_sum[:, None, :], d_given.sum(axis=(2, 3))[:, None, :]
        d_projected = np.zeros((2, len(x) + 1, 3 * STATE), states.dtype)
        for way, places in enumerate((at.T, at.T[::-1])):
            flat = np.where(places < 0, len(x), places).ravel()
            for k in range(3 * STATE):
                d_projected[way, :, k] = np.bincount(flat, d_given[way, k].ravel(), len(x) + 1)
        d_projected = d_projected[:, :-1]
        g["input"] = x.T @ d_projected
        return g, (d_projected @ p["input"].transpose(0, 2, 1)).sum(axis=0)


def known_words(texts: list[list[str]], least: int, most: int) -> dict[str, int]:
    """Words of at least ``least`` texts, the most frequent ``most`` of them; number 0 is for all others."""
    count = Counter(w for words in texts for w in set(words))
    ranked = sorted((w for w, n in count.items() if n >= least), key=lambda w: (-count[w], w))
    return {w: k + 1 for k, w in enumerate(ranked[:most])}


def log_odds(have: np.ndarray, total: np.ndarray, prior: float = 3.0) -> np.ndarray:
    """How much likelier texts labelled 1 have something than others, as a logarithm. It is drawn to zero where few texts have it or chance explains it.

    have: texts of label 0 and 1 (rows) that have each thing; total: all texts of either label.
    """
    share = total[1] / total.sum()
    odds = np.log((have[1] + prior * share) / (total[1] + prior)) - np.log((have[0] + prior * (1 - share)) / (total[0] + prior))
    chance = (have[0] + have[1]) * share * (1 - share) + 1e-9
    return odds * np.clip(1 - 4 * chance / ((have[1] - (have[0] + have[1]) * share) ** 2 + 1e-9), 0, 1)


def train(texts: list[list[str]], labels: np.ndarray, steps: int, batch: int = 256, rate: float = 0.01, decay: float = 10.0, dropped: float = 0.2, passes: int = 20, least: int = 3, most: int = 20_000, seed: int = 11) -> Network:
    """A network that tells windows of texts labelled 1. Each step draws as many windows of either label, and all windows may be drawn."""
    net, draw = Network(known_words(texts, least, most), seed), np.random.default_rng(seed)
    numbers: dict[str, int] = {}
    coded = [np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64) for words in texts]
    ids = np.array([net.vocabulary.get(w, 0) for w in numbers], np.int64)
    g = grams(list(numbers))
    have_words, have_chars, total = np.zeros((2, len(net.vocabulary) + 1)), np.zeros((2, BUCKETS)), np.bincount(labels.astype(int), minlength=2).astype(float)
    for words, y in zip(coded, labels.astype(int), strict=True):
        there = np.unique(words)
        have_words[y][np.unique(ids[there])] += 1
        have_chars[y][np.unique(np.concatenate([g.buckets[g.starts[w] : g.starts[w] + g.counts[w]] for w in there] or [[]]).astype(int))] += 1
    net.p["words"][1:, 0] = log_odds(have_words, total)[1:]
    net.p["chars"][:, 1] = log_odds(have_chars, total)
    owners = [np.array([(k, low) for k in np.flatnonzero(labels == y) for low in window_starts(len(coded[k]))], np.int64).reshape(-1, 2) for y in (0, 1)]
    if not all(map(len, owners)):
        return net
    steps = max(1, min(steps, passes * len(owners[1]) * 2 // batch, passes * len(owners[0]) * 2 // batch))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        chosen = [o[draw.integers(0, len(o), batch // 2)] for o in owners]
        target = np.repeat(np.float32([0, 1]), batch // 2)
        tokens = np.full((batch, WINDOW), -1, np.int64)
        for row, (k, low) in zip(tokens, np.concatenate(chosen), strict=True):
            piece = coded[k][low : low + WINDOW]
            row[: len(piece)] = piece
        there, at = np.unique(tokens, return_inverse=True)
        at = at.reshape(tokens.shape)
        if there[0] < 0:
            there, at = there[1:], at - 1
        counts = g.counts[there]
        flat = np.repeat(g.starts[there] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        own = Grams(g.buckets[flat], np.cumsum(counts) - counts, counts)
        drop = (draw.random(len(there)) > dropped).astype(np.float32)
        kept: list = []
        x = net.inputs(ids[there], own, drop)
        logit = net.forward(x, at, kept)
        error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30)))) - target) / batch
        found, d_x = net.backward(x, at, kept, error.astype(np.float32))
        d_chars = np.repeat(d_x / np.sqrt(counts[:, None]), counts, axis=0)
        d_words = d_x * drop[:, None]
        found["chars"] = np.stack([np.bincount(own.buckets, d_chars[:, k], BUCKETS) for k in range(INPUT)], axis=1).astype(np.float32)
        found["words"] = np.stack([np.bincount(ids[there], d_words[:, k], len(net.p["words"])) for k in range(INPUT)], axis=1).astype(np.float32)
        norm = np.sqrt(sum(float((v * v).sum()) for v in found.values()))
        slow = rate * min(1.0, 2 * (steps - step) / steps + 0.02) * min(1.0, 1 / (norm + 1e-12))
        for k, v in found.items():
            first, second = moments[k]
            first += 0.1 * (v - first)
            second += 0.01 * (v * v - second)
            if k in ("words", "chars"):
                net.p[k] *= 1 - slow * decay
            net.p[k] -= slow * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return net


#: Windows that are scored at once, words of a text that are taken at once, and words whose inputs are made at once.
WINDOWS_AT_ONCE, PIECE, WORDS_AT_ONCE = 4096, 1 << 15, 1 << 18


def pieces(text: str | None) -> Iterator[list[str]]:
    """A text's words in pieces, each with the words that its last window shares with the next. Only a piece is held at once."""
    found, words = (m.group() for m in WORD.finditer((text or "").lower())), []
    while more := list(islice(found, PIECE + WINDOW - STRIDE - len(words))):
        words += more
        yield words
        words = words[PIECE:]


def window_logits(net: Network, texts: Iterable[str | None]) -> list[np.ndarray]:
    """Logits of all overlapping windows of each whole text. Words that occur several times at once are made to inputs once."""
    out: list[list[np.ndarray]] = []
    waiting: list[tuple[int, range, list[str]]] = []

    def score() -> None:
        numbers: dict[str, int] = {}
        coded = [np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32) for _, _, words in waiting]
        listed, counts = list(numbers), [len(starts) for _, starts, _ in waiting]
        if not listed:
            return
        x = net.inputs(np.fromiter((net.vocabulary.get(w, 0) for w in listed), np.int64, len(listed)), grams(listed))
        tokens, row = np.full((sum(counts), WINDOW), -1, np.int32), 0
        for (_, starts, _), words in zip(waiting, coded, strict=True):
            for low in starts:
                own = words[low : low + WINDOW]
                tokens[row, : len(own)] = own
                row += 1
        logits = np.concatenate([net.forward(x, tokens[low : low + WINDOWS_AT_ONCE]) for low in range(0, len(tokens), WINDOWS_AT_ONCE)] or [np.zeros(0, np.float32)])
        for (k, _, _), own in zip(waiting, np.split(logits, np.cumsum(counts)[:-1]), strict=True):
            out[k].append(own)
        waiting.clear()

    words_waiting = 0
    for k, text in enumerate(texts):
        out.append([])
        for part, words in enumerate(pieces(text)):
            starts = window_starts(len(words)) if part == 0 else range(0, max(len(words) - WINDOW + STRIDE, 0), STRIDE)
            waiting.append((k, starts, words))
            words_waiting += len(words)
            if words_waiting >= WORDS_AT_ONCE:
                score()
                words_waiting = 0
    score()
    return [np.concatenate(x) if x else np.zeros(0, np.float32) for x in out]
