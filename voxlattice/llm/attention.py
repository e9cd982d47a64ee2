"""A causal self-attention model of subword ids in numpy: counting, training and scoring.

Each place attends, with trained queries, keys and distance weights, to itself and the places before it. The value of a
place is the distribution of the token that follows it directly or with one token between, counted over all training
texts; for all places further back, the distribution with three tokens between stands in, whatever their distance. Pairs
of tokens and cells of their table are kept up to a bound, the most frequent ones; the rest falls back. Two more values can be attended to: what follows the last two tokens, for
frequent pairs, and what is frequent anywhere, so that nothing has probability zero. A mixture of distributions is one,
so the probabilities of all tokens sum to one without a softmax over the vocabulary. Rare ids share rows of the model;
their training counts tell them apart.

Context windows of SPAN places overlap by OVERLAP: each scores its last STEP ids once, with at least OVERLAP places of
context where the text has them. Windows go in batches; a mask hides later places, another what lies before the text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STEP, OVERLAP, KEY = 8, 4, 4
SPAN = STEP + OVERLAP
#: Rows; rows that rare ids share; pairs of rows with values of their own; cells of these that are kept, at most.
ROWS, SHARED, PAIRS, CELLS = 1024, 63, 1 << 16, 1 << 22
#: The row of what is not there: places before a text and after its end.
ABSENT = ROWS - 1
OWN = ABSENT - SHARED
#: Distances (tokens between) that are counted for values further on, and weight of what a value falls back to.
FURTHER, PRIOR, LEVELS = (3,), 1.0, 48
_HIDDEN = np.float32(-80)
_BETWEEN = np.arange(STEP)[:, None] + OVERLAP - np.arange(SPAN)[None, :]
_SEEN = _BETWEEN >= 0
_DISTANCE = np.clip(_BETWEEN, 0, SPAN - 1)
_PLACE = np.arange(STEP)


@dataclass
class Inventory:
    """What full training counts give each subword: its row and its share of the row."""

    row: np.ndarray
    log10_share: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> "Inventory":
        """counts: training occurrences of each id. The most frequent ids have rows of their own, others share rows."""
        order = np.lexsort((np.arange(len(counts)), -counts))
        row = np.empty(len(counts), np.uint16)
        row[order[:OWN]] = np.arange(min(OWN, len(order)))
        row[order[OWN:]] = OWN + np.arange(len(order[OWN:])) % SHARED
        weight = counts + 0.05
        return cls(row, np.log10(weight / np.bincount(row, weight, ROWS)[row]))


def laid_out(rows: np.ndarray, ends: np.ndarray, end_row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' rows in one line, where each window begins there, and each window's text. Around a text stand OVERLAP
    absent places and the end, which its first id follows, and the end and absent places up to a whole window."""
    count = np.diff(ends, prepend=0)
    blocks = count // STEP + 1
    size = OVERLAP + 1 + blocks * STEP
    begin = np.cumsum(size) - size
    flat = np.full(int(size.sum()), ABSENT, np.uint16)
    flat[begin + OVERLAP] = end_row
    flat[np.repeat(begin + OVERLAP + 1 - (ends - count), count) + np.arange(len(rows))] = rows
    flat[begin + OVERLAP + 1 + count] = end_row
    text = np.repeat(np.arange(len(blocks)), blocks)
    return flat, begin[text] + (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * STEP, text


def cut(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Windows (SPAN places of context overlap STEP targets): all but the last place, and the last STEP, of each."""
    return np.lib.stride_tricks.sliding_window_view(flat, SPAN + 1)[at].astype(np.int64)


def followers(flat: np.ndarray) -> list[np.ndarray]:
    """Cells (row * ROWS + row) of what follows what: directly, with one token between, and further on."""
    wide = flat.astype(np.int32)

    def cells(between: int) -> np.ndarray:
        a, b = wide[: -1 - between], wide[1 + between :]
        real = (a != ABSENT) & (b != ABSENT)
        return a[real] * ROWS + b[real]

    return [cells(0), cells(1), np.concatenate([cells(d) for d in FURTHER])]


def pair_followers(flat: np.ndarray, pair_of: np.ndarray) -> np.ndarray:
    """Cells (pair * ROWS + row) of what follows the pairs that have a number."""
    wide = flat.astype(np.int32)
    pair = pair_of[wide[:-2] * ROWS + wide[1:-1]]
    real = (pair > 0) & (wide[1:-1] != ABSENT) & (wide[2:] != ABSENT)
    return pair[real] * ROWS + wide[2:][real]


def pairs_of(direct: np.ndarray, end_row: int) -> np.ndarray:
    """The number of each pair of rows (0: none of its own): a text's start, and the most frequent pairs."""
    out = np.zeros(ROWS * ROWS, np.int32)
    top = np.argsort(-direct, kind="stable")[: PAIRS - 2]
    top = top[direct[top] > 0]
    out[top] = np.arange(2, 2 + len(top))
    out[ABSENT * ROWS + end_row] = 1
    return out


@dataclass
class Sparse:
    """Counts of cells, found by their rank among the bits of those that are there; other cells count 0."""

    bits: np.ndarray
    before: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, cells: np.ndarray, n: np.ndarray, size: int) -> "Sparse":
        """cells: rising."""
        bits = np.zeros(-(-size // 64), np.uint64)
        first = np.flatnonzero(np.diff(cells >> 6, prepend=-1))
        if len(first):
            bits[cells[first] >> 6] = np.bitwise_or.reduceat(np.uint64(1) << (cells & 63).astype(np.uint64), first)
        there = np.bitwise_count(bits).astype(np.int32)
        return cls(bits, np.cumsum(there, dtype=np.int32) - there, np.append(n, 0).astype(np.float32))

    def take(self, cells: np.ndarray) -> np.ndarray:
        word = cells >> 6
        bits = self.bits.take(word)
        own = bits >> (cells & 63).astype(np.uint64)
        # Rank: the bits up to this one are those of the word less those from it on.
        rank = self.before.take(word) + np.bitwise_count(bits)
        rank -= np.bitwise_count(own)
        return self.n.take(np.where(own & np.uint64(1), rank, -1))


@dataclass
class Values:
    """Distributions of the next row: after a row directly, with one between, further on; after a pair; anywhere. What
    a pair's cells lack of its total goes to what follows its second row directly."""

    direct: np.ndarray
    skipped: np.ndarray
    further: np.ndarray
    anywhere: np.ndarray
    pair_of: np.ndarray
    level: np.ndarray
    cells: Sparse
    total: np.ndarray
    spare: np.ndarray
    off: np.float32

    @classmethod
    def of(cls, counts: dict[str, np.ndarray], pair_of: np.ndarray, cells: np.ndarray, n: np.ndarray, totals: np.ndarray, left_out: bool = False) -> "Values":
        """counts: dense tables of what follows rows; cells and n: of what follows pairs; totals: of pairs. left_out: what
        a training place sees, its own count taken off, so that training does not trust values that it has made itself."""
        anywhere = counts["direct"].reshape(ROWS, ROWS).sum(0) + 0.5
        anywhere[ABSENT] = 0
        anywhere /= anywhere.sum()

        def smooth(n: np.ndarray) -> np.ndarray:
            n = n.reshape(-1, ROWS)
            total = n.sum(1, keepdims=True)
            if left_out:
                n, total = np.maximum(n - 1, 0), np.maximum(total - 1, 0)
            return ((n + PRIOR * anywhere) / (total + PRIOR)).astype(np.float32)

        direct, skipped, further = (smooth(counts[name]) for name in ("direct", "skipped", "further"))
        spare = totals - np.bincount(cells // ROWS, n, PAIRS) + PRIOR
        level = np.minimum(np.log2(totals + 1), LEVELS - 1).astype(np.int64)
        return cls(direct, skipped, further, anywhere.astype(np.float32), pair_of, level, Sparse.of(cells, n, PAIRS * ROWS), (totals + PRIOR).astype(np.float32), spare.astype(np.float32), np.float32(left_out))

    def paired(self, pair: np.ndarray, target: np.ndarray, direct: np.ndarray) -> np.ndarray:
        """What a pair gives a target to which its second row gives `direct`."""
        n = np.maximum(self.cells.take(pair * ROWS + target) - self.off, 0)
        return (n + self.spare.take(pair) * direct) / np.maximum(self.total.take(pair) - self.off, np.float32(PRIOR))


def fresh(seed: int = 7) -> dict[str, np.ndarray]:
    """Queries q and keys k of rows, weights o of distances, g of what is frequent anywhere, c of pairs, h of how often
    a pair occurs (its level: powers of two)."""
    rng = np.random.default_rng(seed)
    out = {"q": rng.normal(0, 0.1, (ROWS, KEY)), "k": rng.normal(0, 0.1, (ROWS, KEY)), "o": -0.2 * np.arange(SPAN), "g": np.full(ROWS, -2.0), "c": np.zeros(PAIRS), "h": np.full(LEVELS, 2.0)}
    return {name: x.astype(np.float32) for name, x in out.items()}


def _attend(p: dict, values: Values, window: np.ndarray) -> tuple:
    """For each target its unnormalised attention to the places (a), the anywhere value (u) and the pair's (b), each
    also times what the value gives the target; and what gradients need."""
    context, target = window[:, :SPAN], window[:, OVERLAP + 1 :]
    here = context[:, OVERLAP:]
    q, k = p["q"].take(here, 0), p["k"].take(context, 0)
    a = np.matmul(q, k.transpose(0, 2, 1))
    a += np.where(_SEEN, p["o"][_DISTANCE], _HIDDEN)
    absent = context == ABSENT
    if absent.any():
        some = np.flatnonzero(absent.any(1))
        a[some] += np.where(absent[some], _HIDDEN, np.float32(0))[:, None, :]
    np.exp(a, out=a)
    after = context * ROWS
    worth = values.further.take(after[:, None, :] + target[:, :, None])
    direct = values.direct.take(after[:, OVERLAP:] + target)
    worth[:, _PLACE, _PLACE + OVERLAP] = direct
    worth[:, _PLACE, _PLACE + OVERLAP - 1] = values.skipped.take(after[:, OVERLAP - 1 : -1] + target)
    worth *= a
    pair = values.pair_of.take(after[:, OVERLAP - 1 : -1] + here)
    u = np.exp(p["g"].take(here))
    b = np.exp(p["c"].take(pair) + p["h"].take(values.level.take(pair)))
    b *= pair > 0
    u_worth, b_worth = u * values.anywhere.take(target), b * values.paired(pair, target, direct)
    whole = _summed(a) + u + b
    return whole, _summed(worth) + u_worth + b_worth, a, worth, (u, u_worth), (b, b_worth), (q, k, pair)


def _summed(x: np.ndarray) -> np.ndarray:
    """Sums of the last, short axis: as a product."""
    return (x.reshape(-1, x.shape[2]) @ np.ones(x.shape[2], x.dtype)).reshape(x.shape[:2])


def score(p: dict, values: Values, inventory: Inventory, ids: np.ndarray, ends: np.ndarray, end_id: int, batch: int = 2048) -> np.ndarray:
    """log10 of each text's probability: its ids and the end."""
    flat, at, text = laid_out(inventory.row[ids], ends, int(inventory.row[end_id]))
    logs = np.empty(len(at))
    for i in range(0, len(at), batch):
        window = cut(flat, at[i : i + batch])
        whole, likely = _attend(p, values, window)[:2]
        real = window[:, OVERLAP + 1 :] != ABSENT
        logs[i : i + batch] = np.log10(np.where(real, likely, 1) / np.where(real, whole, 1)).sum(1, dtype=np.float64)
    share = np.concatenate([[0], np.cumsum(inventory.log10_share[ids])])
    return np.bincount(text, logs, len(ends)) + np.diff(share[ends], prepend=0) + inventory.log10_share[end_id]


def _gather(rows: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """Sums gradients of equal rows."""
    rows = rows.ravel().astype(np.uint16)
    order = np.argsort(rows, kind="stable")
    ranked = rows[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    sums = np.zeros((ROWS, gradient.shape[-1]), gradient.dtype)
    sums[ranked[first]] = np.add.reduceat(gradient.reshape(rows.size, -1)[order], first, axis=0)
    return sums


def gradients(p: dict, values: Values, window: np.ndarray) -> tuple[dict, float]:
    """Gradients of the mean loss over the real targets of the windows, and that loss."""
    whole, likely, a, worth, (u, u_worth), (b, b_worth), (q, k, pair) = _attend(p, values, window)
    context, real = window[:, :SPAN], window[:, OVERLAP + 1 :] != ABSENT
    here, n = context[:, OVERLAP:], max(1, int(real.sum()))
    whole, likely = np.where(real, whole, np.float32(1)), np.where(real, likely, np.float32(1))
    loss = float(np.log(whole / likely).sum()) / n
    # Attention less its share in the target's probability: the gradient of the scores.
    share = real.astype(q.dtype) / np.float32(n)
    whole, likely = share / whole, share / likely
    a *= whole[:, :, None]
    worth *= likely[:, :, None]
    a -= worth
    kind, by_pair = q.dtype, np.bincount(pair.ravel(), (b * whole - b_worth * likely).ravel(), PAIRS)
    return {
        "q": _gather(here, np.matmul(a, k)),
        "k": _gather(context, np.matmul(a.transpose(0, 2, 1), q)),
        "o": np.bincount(_DISTANCE.ravel(), (a.sum(0) * _SEEN).ravel(), SPAN).astype(kind),
        "g": np.bincount(here.ravel(), (u * whole - u_worth * likely).ravel(), ROWS).astype(kind),
        "c": by_pair.astype(kind),
        "h": np.bincount(values.level, by_pair, LEVELS).astype(kind),
    }, loss


class Trainer:
    """Adam over the windows of texts that come in one after another, in random order among those at hand; the rate
    falls from step to step, whatever is still to come."""

    def __init__(self, p: dict, values: Values, rate: float, seed: int, batch: int = 4096):
        self.p = {name: x.copy() for name, x in p.items()}
        self.m, self.s = ({name: np.zeros_like(x) for name, x in p.items()} for _ in range(2))
        self.values, self.rate, self.batch, self.steps, self.windows = values, rate, batch, 0, 0
        self.random = np.random.default_rng(seed)

    def learn(self, flat: np.ndarray, at: np.ndarray) -> None:
        order = self.random.permutation(len(at))
        self.windows += len(at)
        for i in range(0, len(order), self.batch):
            g, _ = gradients(self.p, self.values, cut(flat, at[np.sort(order[i : i + self.batch])]))
            self.steps += 1
            now = np.float32(self.rate / (1 + self.steps / 50) ** 0.5)
            for name, x in g.items():
                m, s = self.m[name], self.s[name]
                m += np.float32(0.1) * (x - m)
                s += np.float32(0.01) * (x * x - s)
                self.p[name] -= now * (m / np.float32(1 - 0.9**self.steps)) / (np.sqrt(s / np.float32(1 - 0.99**self.steps)) + np.float32(1e-8))


def packed(p: dict) -> bytes:
    return b"".join(p[name].astype("<f4").tobytes() for name in sorted(p))


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    out, at, flat = {}, 0, np.frombuffer(data, "<f4")
    for name, like in sorted(fresh().items()):
        out[name] = flat[at : at + like.size].reshape(like.shape).copy()
        at += like.size
    return out
