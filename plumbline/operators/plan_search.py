"""Budget plans under many replicates of a law: every scenario optimised under every replicate (A).

The replicates are a table of a few hundred rows, known to every task; scenarios come in batches and are worked on as arrays of
(scenarios x replicates), a quality level at a time. Nothing is shuffled, and a task holds SLICE scenarios at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd

from plumbline.operators.allocation import Bounds
from plumbline.operators.scoring_jobs import TOLERANCES

SLICE = 256  # scenarios whose arrays a task holds at once
Law = Mapping[str, np.ndarray]
Frames = Iterator[pd.DataFrame]
_PLAN = ("loss", "n", "d", "q")


class Scenarios:
    """Compute `c`, cost `k` of a token per unit of size, and per quality level its cost `r`, its bounds of size, and who can have it."""

    def __init__(self, rows: pd.DataFrame, qs: Sequence[float], b: Bounds):
        self.qs, self.b = qs, b
        self.c, self.k = rows["c"].to_numpy()[:, None], rows["k"].to_numpy()[:, None]
        self.r = np.stack(rows["r"].to_numpy()) if len(rows) else np.zeros((0, len(qs)))
        self.low = np.maximum(b.n_min, (self.c / b.d_max - self.r) / self.k)
        self.high = np.minimum(b.n_max, (self.c / b.d_min - self.r) / self.k)
        self.open = (self.high >= b.n_min) & (np.asarray(qs) >= rows["q0"].to_numpy()[:, None])

    def tokens(self, n: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.minimum(self.b.d_max, self.c / (self.k * n + r))

    def best_size(self, law: Law, j: int, steps: int = 8) -> np.ndarray:
        """The sizes of `lawfit.best_size` at quality level j."""
        alpha, beta, r = law["alpha"], law["beta"], self.r[:, j:j + 1]
        c0 = np.log(alpha * law["A"] / (beta * law["B"])) + beta * np.log(self.c) - np.log(self.k)
        x = (c0 + (1 - beta) * np.log(self.k)) / (alpha + beta)
        for _ in range(steps):
            paid = self.k * np.exp(x)
            cost = paid + r
            x = x + (c0 - (1 + alpha) * x + (1 - beta) * np.log(cost)) / ((1 + alpha) - (1 - beta) * paid / cost)
        return np.minimum(self.high[:, j:j + 1], np.maximum(self.low[:, j:j + 1], np.exp(x)))

    def best_plan(self, law: Law) -> dict[str, np.ndarray]:
        """Least loss over the quality grid, the size optimised inside; ties go to the smaller model, fewer tokens, lower quality."""
        best = None
        for j, q in enumerate(self.qs):
            n = self.best_size(law, j)
            d = self.tokens(n, self.r[:, j:j + 1])
            best = _lesser(best, {"loss": loss(law, n, d, q), "n": n, "d": d, "q": np.full_like(n, q)}, self.open[:, j:j + 1], ("loss", "n", "d", "q"))
        return best


def loss(law: Law, n: np.ndarray, d: np.ndarray, q) -> np.ndarray:
    return law["E"] + (law["A"] * np.exp(-law["alpha"] * np.log(n)) + law["B"] * np.exp(-law["beta"] * np.log(d))) * (1 + law["kappa"] * (1 - q))


def _lesser(best: dict | None, new: dict, may: np.ndarray, order: Sequence[str]) -> dict:
    """Of two plans the lesser by `order`, where the new one is allowed; before the first, loss is infinite."""
    if best is None:
        best = {c: np.full_like(v, np.inf) for c, v in new.items()}
    wins, level = np.zeros(may.shape, bool), np.ones(may.shape, bool)
    for c in order:
        wins = wins | (level & (new[c] < best[c]))
        level = level & (new[c] == best[c])
    wins = wins & may
    return {c: np.where(wins, new[c], best[c]) for c in new}


def quantile(ordered: np.ndarray, share: float) -> np.ndarray:
    """Quantile with linear interpolation along the last, sorted axis."""
    spot = share * (ordered.shape[-1] - 1)
    a, b = ordered[..., int(np.floor(spot))], ordered[..., int(np.ceil(spot))]
    return a + (spot - np.floor(spot)) * (b - a)


def _touches(v: np.ndarray, bound: float) -> np.ndarray:
    return np.abs(v - bound) <= max(TOLERANCES[0], TOLERANCES[1] * max(abs(bound), 1.0))


def _sliced(work: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Frames], Frames]:
    def per_partition(frames: Frames) -> Frames:
        for frame in frames:
            for at in range(0, len(frame), SLICE):
                with np.errstate(all="ignore"):  # sizes and tokens of levels that are not open have no logarithm
                    yield work(frame.iloc[at:at + SLICE])

    return per_partition


OPTIMA = "id long, family string, replicates long, loss_low double, loss_median double, loss_high double, n_low double, n_median double, n_high double, d_median double, q_median double, n_upper double, d_upper double, q_upper double"


def replicate_optima(reps: Law, qs: Sequence[float], b: Bounds) -> Callable[[Frames], Frames]:
    """Quantiles of each scenario's plans over the replicates, and how often they touch an upper bound."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        s = Scenarios(rows, qs, b)
        keep = s.open.any(axis=1)
        plan = {c: v[keep] for c, v in s.best_plan(reps).items()}
        ordered = {c: np.sort(plan[c], axis=1) for c in _PLAN}
        out = {"id": rows["id"][keep], "family": rows["family"][keep], "replicates": len(reps["E"])}
        out |= {f"{c}_{name}": quantile(ordered[c], share) for c in ("loss", "n") for name, share in (("low", 0.025), ("median", 0.5), ("high", 0.975))}
        out |= {f"{c}_median": quantile(ordered[c], 0.5) for c in ("d", "q")}
        return pd.DataFrame(out | {f"{c}_upper": _touches(plan[c], bound).mean(axis=1) for c, bound in (("n", b.n_max), ("d", b.d_max), ("q", b.q_max))})

    return _sliced(work)


RISK = "id long, family string, n double, q double, p90_loss double, p90_regret double, max_regret double, nominal_p90_regret double, nominal_max_regret double"


def risk_decisions(own: Law, reps: Law, qs: Sequence[float], ratios: Sequence[float], b: Bounds) -> Callable[[Frames], Frames]:
    """Plan with the least 90 % loss among the sizes at `ratios` to the best size of law `own`, per quality level, and its regrets."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        s = Scenarios(rows, qs, b)
        keep = s.open.any(axis=1)
        least, nominal, pick = s.best_plan(reps)["loss"], s.best_plan(own), None
        for j, q in enumerate(qs):
            size = s.best_size(own, j)
            for ratio in ratios:
                n = np.minimum(s.high[:, j:j + 1], np.maximum(s.low[:, j:j + 1], size * ratio))
                d = s.tokens(n, s.r[:, j:j + 1])
                p90 = quantile(np.sort(loss(reps, n, d, q), axis=1), 0.9)[:, None]
                pick = _lesser(pick, {"p90": p90, "n": n, "q": np.full_like(n, q), "d": d}, s.open[:, j:j + 1], ("p90", "n", "q"))
        out = {"id": rows["id"][keep], "family": rows["family"][keep], "n": pick["n"][keep, 0], "q": pick["q"][keep, 0], "p90_loss": pick["p90"][keep, 0]}
        for name, plan in (("", pick), ("nominal_", nominal)):
            regret = np.sort((loss(reps, plan["n"], plan["d"], plan["q"]) - least)[keep], axis=1)
            out |= {f"{name}p90_regret": quantile(regret, 0.9), f"{name}max_regret": regret[:, -1]}
        return pd.DataFrame(out)

    return _sliced(work)
