"""A semi-Markov conditional random field: spans of tokens with a type each, and tokens outside.

A *lattice* is the number of tokens and all candidate segments, each with the
features of the whole segment as one type. The score of a segmentation is the
sum of the weights of its segments' features and of one transition per step,
``before>after``, where ``before`` is the type of the segment before, ``none``
for a token outside, or ``start``. A token outside has no features.

``decode`` finds the best segmentation by dynamic programming, in time linear
in the tokens and with a few bytes of memory per token. ``expectations`` runs
forward and backward over all segmentations, and ``train`` climbs the
conditional log-likelihood of given segmentations, less a quadratic penalty
for leaving the start weights, by L-BFGS.

Cases: without tokens there is no segment; ties go to fewer segments; without
examples the start weights come back.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict, deque
from collections.abc import Callable, Iterable

START, OUTSIDE = "start", "none"

#: Tokens of a segment at most; ``decode`` keeps a length and a type in one byte.
MAX_TOKENS = 20
_TYPES = 8

Weights = dict[str, float]
Segment = tuple[int, int, str, tuple[str, ...]]  # first token, last token, type, features
Lattice = tuple[int, tuple[Segment, ...]]
Chosen = tuple[str, int, int]  # type, first token, last token
Example = tuple[Lattice, tuple[Chosen, ...]]


def transition(before: str, after: str) -> str:
    return f"{before}>{after}"


def score(features: Iterable[str], weights: Weights) -> float:
    return sum(weights.get(f, 0.0) for f in features)


def decode(n: int, ending: Callable[[int], Iterable[Segment]], types: tuple[str, ...], weights: Weights) -> list[Chosen]:
    """The best segments of ``n`` tokens; ``ending(j)`` gives the candidates whose last token is ``j``."""
    names = (START, OUTSIDE, *types)
    number = {name: k for k, name in enumerate(names)}
    step = [[weights.get(transition(b, a), 0.0) for a in names] for b in names]
    none = float("-inf")
    back = bytearray((n + 1) * len(names))
    window: deque[list[float]] = deque([[0.0] + [none] * (len(names) - 1)], maxlen=MAX_TOKENS)
    for j in range(n):
        here = [none] * len(names)
        for i, _, name, features in ((j, j, OUTSIDE, ()), *ending(j)):
            value, kind = score(features, weights), number[name]
            for b, before in enumerate(window[i - j - 1]):
                if before == none:
                    continue
                total = before + value + step[b][kind]
                if total > here[kind] + 1e-9:
                    here[kind] = total
                    back[(j + 1) * len(names) + kind] = (j + 1 - i) * _TYPES + b
        window.append(here)
    found: list[Chosen] = []
    last = window[-1]
    kind = 1 if n else 0
    for k, value in enumerate(last):
        if value > last[kind] + 1e-9:
            kind = k
    at = n
    while at:
        length, before = divmod(back[at * len(names) + kind], _TYPES)
        if kind > 1:
            found.append((names[kind], at - length, at - 1))
        at, kind = at - length, before
    return found[::-1]


def _steps(lattice: Lattice) -> list[list[tuple[int, str, tuple[str, ...]]]]:
    """For every end the segments that end there: start, type, features."""
    n, segments = lattice
    ends: list[list[tuple[int, str, tuple[str, ...]]]] = [[] for _ in range(n + 1)]
    for j in range(n):
        ends[j + 1].append((j, OUTSIDE, ()))
    for i, j, kind, features in segments:
        ends[j + 1].append((i, kind, features))
    return ends


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def expectations(lattice: Lattice, weights: Weights) -> tuple[float, Counter[str]]:
    """The logarithm of the sum over all segmentations, and how often each feature and transition is expected."""
    n = lattice[0]
    ends = _steps(lattice)
    paths: list[dict[str, list[float]]] = [defaultdict(list) for _ in range(n + 1)]
    forward: list[dict[str, float]] = [{START: 0.0}]
    arcs = []
    for j in range(1, n + 1):
        for i, kind, features in ends[j]:
            value = score(features, weights)
            for before, so_far in forward[i].items():
                gain = value + weights.get(transition(before, kind), 0.0)
                paths[j][kind].append(so_far + gain)
                arcs.append((i, before, j, kind, features, gain))
        forward.append({kind: _log_sum(values) for kind, values in paths[j].items()})
    total = _log_sum(list(forward[n].values()))
    backward: list[dict[str, float]] = [{} for _ in range(n)] + [dict.fromkeys(forward[n], 0.0)]
    onward: list[dict[str, list[float]]] = [defaultdict(list) for _ in range(n + 1)]
    expected: Counter[str] = Counter()
    done = n
    for i, before, j, kind, features, gain in reversed(arcs):  # arcs are in order of their ends
        while done > j:
            done -= 1
            backward[done] = {k: _log_sum(v) for k, v in onward[done].items()}
        rest = gain + backward[j][kind]
        onward[i][before].append(rest)
        share = math.exp(forward[i][before] + rest - total)
        expected[transition(before, kind)] += share
        for f in features:
            expected[f] += share
    return total, expected


def observed(example: Example) -> Counter[str] | None:
    """Features and transitions of the given segmentation; None if the lattice has no such path."""
    (n, segments), gold = example
    known = {(kind, i, j): features for i, j, kind, features in segments}
    counts: Counter[str] = Counter()
    at, before = 0, START
    for kind, i, j in sorted(gold, key=lambda g: g[1]):
        if (kind, i, j) not in known or i < at:
            return None
        for _ in range(i - at):
            counts[transition(before, OUTSIDE)] += 1
            before = OUTSIDE
        counts[transition(before, kind)] += 1
        counts.update(known[kind, i, j])
        at, before = j + 1, kind
    for _ in range(n - at):
        counts[transition(before, OUTSIDE)] += 1
        before = OUTSIDE
    return counts


def likelihood(
    examples: list[tuple[Example, int]], weights: Weights, start: Weights, strength: float
) -> tuple[float, Weights]:
    """The penalised log-likelihood of examples with their counts, and its gradient."""
    value, gradient = 0.0, defaultdict(float)
    for example, count in examples:
        seen = observed(example)
        total, expected = expectations(example[0], weights)
        value += count * (sum(c * weights.get(f, 0.0) for f, c in seen.items()) - total)
        for f in seen.keys() | expected.keys():
            gradient[f] += count * (seen[f] - expected[f])
    for f in gradient.keys() | weights.keys():
        away = weights.get(f, 0.0) - start.get(f, 0.0)
        value -= strength / 2 * away * away
        gradient[f] -= strength * away
    return value, dict(gradient)


def train(
    examples: list[tuple[Example, int]],
    start: Weights,
    moves: Callable[[str], bool],
    strength: float = 1.0,
    rounds: int = 60,
    memory: int = 8,
) -> Weights:
    """Weights of the greatest penalised likelihood; only weights for which ``moves`` holds leave ``start``.

    Examples whose segmentation is no path of their lattice are left out.
    """
    usable = sorted((e, c) for e, c in examples if observed(e) is not None)
    if not usable:
        return dict(start)
    size = sum(c for _, c in usable)
    names = {f for (lattice, _), _ in usable for s in lattice[1] for f in s[3]}
    for (lattice, _), _ in usable:
        kinds = {START, OUTSIDE, *(s[2] for s in lattice[1])}
        names |= {transition(b, a) for b in kinds for a in kinds if a != START}
    moving = sorted(f for f in names if moves(f))

    def at(point: list[float]) -> tuple[float, list[float]]:
        """Loss per example and its gradient."""
        value, gradient = likelihood(usable, start | dict(zip(moving, point, strict=True)), start, strength)
        return -value / size, [-gradient.get(f, 0.0) / size for f in moving]

    dot = lambda a, b: math.fsum(x * y for x, y in zip(a, b, strict=True))
    point = [start.get(f, 0.0) for f in moving]
    loss, slope = at(point)
    past: deque[tuple[list[float], list[float], float]] = deque(maxlen=memory)
    for _ in range(rounds):
        if max(map(abs, slope), default=0.0) < 1e-5:
            break
        way, used = [-g for g in slope], []
        for s, y, curve in reversed(past):
            a = dot(s, way) / curve
            used.append(a)
            way = [w - a * v for w, v in zip(way, y, strict=True)]
        if past:
            s, y, curve = past[-1]
            way = [w * curve / dot(y, y) for w in way]
        for (s, y, curve), a in zip(past, reversed(used), strict=True):
            b = dot(y, way) / curve
            way = [w + (a - b) * v for w, v in zip(way, s, strict=True)]
        down, length = dot(way, slope), 1.0
        while True:
            new = [p + length * w for p, w in zip(point, way, strict=True)]
            new_loss, new_slope = at(new)
            if new_loss <= loss + 1e-4 * length * down or length < 1e-6:
                break
            length /= 2
        if new_loss >= loss:
            break
        s, y = [a - b for a, b in zip(new, point, strict=True)], [a - b for a, b in zip(new_slope, slope, strict=True)]
        if dot(s, y) > 1e-12:
            past.append((s, y, dot(s, y)))
        point, loss, slope = new, new_loss, new_slope
    return start | {f: round(v, 6) for f, v in zip(moving, point, strict=True)}
