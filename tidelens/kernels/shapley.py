"""Overlap groups, coalition values and Shapley shares on the driver or inside a group's task."""

from __future__ import annotations

import math
from bisect import insort

import numpy as np

from tidelens.kernels.linalg import stream

EXACT_PLAYERS, EXACT_LIFT = 12, 6  # up to so many players all coalitions are valued; up to so many by their true lift
TIE = 1e-12  # relative difference of magnitudes that count as equal


def overlap_groups(spots: list[tuple]) -> list[list[tuple]]:
    """(id, start, end) in chains of windows that overlap; windows that only touch don't."""
    groups: list[list[tuple]] = []
    reach = -math.inf
    for s in sorted(spots, key=lambda s: s[1]):
        if groups and s[1] < reach:
            groups[-1].append(s)
            reach = max(reach, s[2])
        else:
            groups.append([s])
            reach = s[2]
    return groups


def union_lift(lift_sums, var_sums, spots) -> tuple[float, float]:
    """Lift and variance over the union of windows, from running sums; touching windows merge."""
    lift = var = 0.0
    end = -1
    for _, a, b in sorted(spots, key=lambda s: (s[1], s[2])):
        a = max(a, end)
        if b > a:
            lift += lift_sums[b] - lift_sums[a]
            var += var_sums[b] - var_sums[a]
            end = b
    return float(lift), float(var)


def rank_decay(lifts: dict, decay: float = 0.7):
    """Value of a coalition: lifts by size, each worth less by its rank; equal sizes share their ranks' mean weight."""

    def value(ids) -> float:
        own = sorted((lifts.get(i, 0.0) for i in ids), key=lambda v: -abs(v))
        total, at = 0.0, 0
        while at < len(own):
            end = at + 1
            while end < len(own) and abs(abs(own[end]) - abs(own[at])) <= TIE * max(abs(own[at]), abs(own[end]), 1.0):
                end += 1
            total += sum(own[at:end]) * sum(decay**k for k in range(at, end)) / (end - at)
            at = end
        return total

    return value


def time_decay(lifts: dict, times: dict, half_life: float = 7.0):
    """Value of a coalition: lifts that fade with their age against the latest of all."""
    if half_life <= 0:
        raise ValueError("half_life must be positive")
    last = max(times.values(), default=0)
    return lambda ids: float(sum(lifts.get(i, 0.0) * math.exp(-math.log(2) / half_life * (last - times.get(i, 0))) for i in ids))


def exact_shares(ids: list, value) -> dict:
    """Shapley shares from the values of all coalitions, each valued once."""
    n = len(ids)
    if n > EXACT_PLAYERS:
        raise ValueError(f"{n} players are more than {EXACT_PLAYERS}")
    ids = sorted(ids)
    worth = np.array([value([ids[i] for i in range(n) if m >> i & 1]) if m else 0.0 for m in range(1 << n)])
    masks = np.arange(1 << n)
    size = np.bitwise_count(masks.astype(np.uint64)).astype(int)
    weight = np.array([math.factorial(s) * math.factorial(n - s - 1) / math.factorial(n) if s < n else 0.0 for s in range(n + 1)])
    out = {}
    for i, who in enumerate(ids):
        without = masks[(masks >> i) & 1 == 0]
        out[who] = float((weight[size[without]] * (worth[without | 1 << i] - worth[without])).sum())
    return out


def sampled_shares(ids: list, value, samples: int = 10_000, seed: int = 42) -> dict:
    """Shapley shares from random orders of the players. Coalitions are remembered among EXACT_PLAYERS or fewer only."""
    ids, rng, known = sorted(ids), stream(seed, "shapley"), {}
    total = dict.fromkeys(ids, 0.0)

    def worth(held: tuple) -> float:
        if len(ids) > EXACT_PLAYERS:
            return value(list(held))
        if held not in known:
            known[held] = value(list(held))
        return known[held]

    for _ in range(samples):
        held, before = [], 0.0
        for i in rng.permutation(len(ids)).tolist():
            insort(held, ids[i])
            now = worth(tuple(held))
            total[ids[i]] += (now - before) / samples
            before = now
    return total


def rank_decay_shares(lifts: dict, decay: float = 0.7) -> dict:
    """Shapley shares of the game rank_decay(lifts, decay), exactly, for any number of players.

    A share is the integral over p in [0, 1] of a player's marginal value where each other player is in with chance p.
    With k players larger than i, a lift adds l_i times the integral of (1 - (1 - d) p)^k, and it pushes each smaller
    lift one rank down. Players of equal size take the mean over all orders among them, as the game does.
    """
    names = sorted(lifts, key=lambda i: (-abs(lifts[i]), str(i)))
    n, c = len(names), 1.0 - decay
    own = np.array([lifts[i] for i in names], np.float64)
    size = np.abs(own)
    first, at = np.zeros(n, np.int64), 0  # of each player's run of equal sizes
    for k in range(n):
        if size[at] - size[k] > TIE * max(size[at], 1.0):
            at = k
        first[k] = at
    k = np.arange(n + 2, dtype=np.float64)
    if c == 0:
        added, pushed = np.ones(n), np.zeros(n)
    else:
        whole = (1 - decay ** (k + 1)) / (k + 1) if decay != 0 else 1 / (k + 1)
        added = whole[:n] / c
        pushed = np.zeros(n)  # by a larger player, for the player at rank k
        pushed[1:] = -(whole[: n - 1] - whole[1:n]) / c
    _, run, m = np.unique(first, return_inverse=True, return_counts=True)
    mean = lambda v: (np.bincount(run, v) / m)[run] if n else v
    below = np.bincount(run, own * mean(pushed)) if n else own
    after = np.concatenate([np.cumsum(below[::-1])[::-1][1:], [0.0]])[run] if n else own
    # Among m equals, the one at place j of the run has the player before it in j of the m (m - 1) ordered pairs.
    place = np.arange(n) - first
    inside = np.bincount(run, place * pushed) / np.maximum(m * (m - 1), 1) if n else own
    others = (np.bincount(run, own)[run] - own) * inside[run] if n else own
    return dict(zip(names, (own * mean(added) + after + others).tolist(), strict=True))


def union_shares(spots: list[tuple], lift_at: dict) -> dict:
    """Shapley shares of the lift over the union of windows, exactly: each step's lift is shared by the windows over it.

    lift_at: running sums of lift at every window's start and end.
    """
    edges = sorted({x for _, a, b in spots for x in (a, b)})
    place = {x: k for k, x in enumerate(edges)}
    cover = np.zeros(len(edges))
    for _, a, b in spots:
        cover[place[a]] += 1
        cover[place[b]] -= 1
    sums = np.array([lift_at[x] for x in edges], np.float64)
    each = np.diff(sums) / np.maximum(np.cumsum(cover)[:-1], 1)
    run = np.concatenate([[0.0], np.cumsum(each)])
    return {i: float(run[place[b]] - run[place[a]]) for i, a, b in spots}


def normalized(shares: dict, total: float) -> dict:
    """Shares that sum to the total; equal ones where they sum to nothing."""
    now = sum(shares.values())
    return {k: total / len(shares) if abs(now) < 1e-10 else v * total / now for k, v in shares.items()}


def allocate(ids: list, total: float, value, samples: int = 10_000, seed: int = 42) -> dict:
    if len(ids) == 1:
        return {ids[0]: total}
    return normalized(exact_shares(ids, value) if len(ids) <= EXACT_PLAYERS else sampled_shares(ids, value, samples, seed), total)


def share_group(group: list[tuple], lift_at: dict, var_at: dict, mode: str | None = None, decay: float = 0.7) -> list[tuple]:
    """(id, lift, variance) of the windows (id, start, end) of one overlap group, from running sums at their edges.

    One window has its own lift. More share their union's lift and variance: up to EXACT_LIFT windows, or in mode
    "exact_lift", by the lift of coalitions; larger groups by lifts that fade with their rank. Both are exact.
    """
    if len(group) == 1:
        i, a, b = group[0]
        return [(i, float(lift_at[b] - lift_at[a]), float(var_at[b] - var_at[a]))]
    total, total_var = union_lift(lift_at, var_at, group)
    if (mode or ("exact_lift" if len(group) <= EXACT_LIFT else "diminishing")) == "exact_lift":
        shares = union_shares(group, lift_at)
    else:
        shares = rank_decay_shares({i: float(lift_at[b] - lift_at[a]) for i, a, b in group}, decay)
    shares = normalized(shares, total)
    size = sum(map(abs, shares.values()))
    return [(i, shares[i], total_var * abs(shares[i]) / size if size > 1e-15 else total_var / len(group)) for i, _, _ in group]


def attribute(y, mean, variance, obs_variance: float, spots: list[tuple], mode: str | None = None, decay: float = 0.7) -> list[tuple]:
    """(id, start, end, lift, variance, group) of each spot: its window's lift, or its share of an overlap group's."""
    y, mean, variance = (np.asarray(v, np.float64) for v in (y, mean, variance))
    if len({s[0] for s in spots}) < len(spots):
        raise ValueError("spot ids must be unique")
    if any(not 0 <= a < b <= len(y) for _, a, b in spots):
        raise ValueError("a spot's window lies outside the series or is empty")
    lift = np.concatenate([[0.0], np.cumsum(y - mean)])
    var = np.concatenate([[0.0], np.cumsum(variance + obs_variance)])
    out = []
    for g, group in enumerate(overlap_groups(spots)):
        found = share_group(group, lift, var, mode, decay)
        out += [(i, a, b, share, v, g) for (i, a, b), (_, share, v) in zip(group, found, strict=True)]
    return out
