"""Filters whose state goes from value to value: the unscented Kalman filter and online autoregression. In batch they
scan each series in order (``chunks.scanned``); the online one also runs on a stream (``streaming.online``)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from chronolake.operators.chunks import scanned


def sigma_weights(n: int, alpha: float, beta: float, kappa: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Spread, and the weights of the 2n + 1 scaled sigma points for means and for covariances."""
    spread = alpha * alpha * (n + kappa)
    means = np.full(2 * n + 1, 0.5 / spread)
    means[0] = 1 - n / spread
    covariances = means.copy()
    covariances[0] += 1 - alpha * alpha + beta
    return spread, means, covariances


def sigma_points(mean: np.ndarray, covariance: np.ndarray, spread: float) -> np.ndarray:
    """The mean, and it plus and minus the columns of the root of ``spread`` times the covariance, as rows. A covariance
    that rounding has made indefinite is taken at its nearest semidefinite one."""
    scaled = spread * (covariance + covariance.T) / 2
    try:
        root = np.linalg.cholesky(scaled)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(scaled)
        root = vectors * np.sqrt(np.maximum(values, 0))
    return np.vstack([mean, mean + root.T, mean - root.T])


@dataclass
class StateModel:
    """A state that moves by ``move`` and is seen through ``look`` (both take states as rows and give as many; what is
    seen is one number), with the covariance of its noise, the variance of the measurement and the start."""

    move: Callable[[np.ndarray], np.ndarray]
    look: Callable[[np.ndarray], np.ndarray]
    process: np.ndarray
    noise: float
    start: np.ndarray
    uncertainty: np.ndarray
    alpha: float = 0.1
    beta: float = 2.0
    kappa: float = -1.0
    weights: tuple[float, np.ndarray, np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        if len(self.start) + self.kappa <= 0:
            self.kappa = 0.0
        self.weights = sigma_weights(len(self.start), self.alpha, self.beta, self.kappa)


def damped_trend(damping: float = 0.98, process: float = 0.01, noise: float = 1.0) -> StateModel:
    """Level and slope; the slope fades by ``damping`` and saturates (tanh) at about one noise deviation a step."""
    reach = float(np.sqrt(noise))
    return StateModel(
        lambda x: np.column_stack([x[:, 0] + reach * np.tanh(x[:, 1] / reach), damping * x[:, 1]]), lambda x: x[:, 0], process * np.eye(2), noise, np.zeros(2), 1e3 * noise * np.eye(2)
    )


def unscented_step(model: StateModel, mean: np.ndarray, covariance: np.ndarray, y: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """State and covariance after ``y``, what was expected, and the expected variance; a missing value only moves."""
    spread, w, c = model.weights
    moved = model.move(sigma_points(mean, covariance, spread))
    mean = w @ moved
    covariance = (moved - mean).T @ ((moved - mean) * c[:, None]) + model.process
    points = sigma_points(mean, covariance, spread)
    seen = model.look(points)
    expected = float(w @ seen)
    variance = float(c @ (seen - expected) ** 2) + model.noise
    if np.isfinite(y):
        gain = ((points - mean).T @ (c * (seen - expected))) / variance
        mean, covariance = mean + gain * (y - expected), covariance - np.outer(gain, gain) * variance
    return mean, covariance, expected, variance


def unscented(long: DataFrame, model: StateModel | None = None) -> DataFrame:
    """series_id, t, expected, variance, level (what the state after the value looks like), score (the residual's size in
    expected deviations; 0 for a missing value) by the unscented Kalman filter."""
    model = model or damped_trend()

    def step(state: tuple, values: np.ndarray) -> tuple[tuple, dict[str, np.ndarray]]:
        mean, covariance = state
        out = np.zeros((4, len(values)))
        for i, y in enumerate(values):
            mean, covariance, out[0, i], out[1, i] = unscented_step(model, mean, covariance, y)
            out[2, i] = model.look(mean[None, :])[0]
            out[3, i] = abs(y - out[0, i]) / np.sqrt(out[1, i]) if np.isfinite(y) else 0.0
        return (mean, covariance), dict(zip(("expected", "variance", "level", "score"), out, strict=True))

    return scanned(long, lambda: (model.start, model.uncertainty), step, "expected double, variance double, level double, score double")


class OnlineAutoregression:
    """Weights of an autoregression of ``order`` lags and a constant, moved after each value by gradient descent on the
    log-cosh loss of its error. With ``project`` weights whose characteristic roots lie too near together within the
    circle are scaled out to it. The state is a list: the weights, then the last values."""

    def __init__(self, order: int = 3, rate: float = 0.001, circle: float = 1.01, project: bool = True):
        self.order, self.rate, self.circle, self.project = order, rate, circle, project

    def begin(self) -> list[float]:
        return [0.005] * (self.order + 1)

    def projected(self, w: np.ndarray) -> np.ndarray:
        roots = np.roots(w[::-1])
        size = float(np.linalg.norm(roots))
        if not 0 < size < self.circle or len(roots) != self.order:
            return w
        return np.real(np.poly(roots * (self.circle / size)))[::-1]

    def step(self, state: list[float], values: np.ndarray) -> tuple[list[float], dict[str, np.ndarray]]:
        """The state after ``values``; expected (nan for the first ``order`` values) and the size of each move. A
        missing value counts as what was expected, or else as 0, and moves nothing."""
        w, past = np.array(state[: self.order + 1]), list(state[self.order + 1 :])
        expected, moves = np.full(len(values), np.nan), np.zeros(len(values))
        for i, y in enumerate(values):
            if len(past) == self.order:
                expected[i] = w[:-1] @ past + w[-1]
            known = np.isfinite(y)
            y = float(y) if known else float(np.nan_to_num(expected[i]))
            if len(past) == self.order and known:
                gradient = np.tanh(expected[i] - y) * np.array([*past, 1.0])
                new = w - self.rate * gradient
                new = self.projected(new) if self.project else new
                moves[i] = float(np.sqrt(((new - w) ** 2).sum()))
                w = new
            past = [*past, y][-self.order :]
        return [*w.tolist(), *past], {"expected": expected, "move": moves}


def online_autoregression(long: DataFrame, model: OnlineAutoregression | None = None) -> DataFrame:
    """series_id, t, expected (nan for the first values), move: how far the weights went at each value. A fault moves
    them far; a threshold on ``move`` is a detector."""
    model = model or OnlineAutoregression()
    return scanned(long, model.begin, model.step, "expected double, move double")
