"""Response families: log-likelihood, score and working weight with respect to the predictor.

All functions take NumPy arrays for the rows of one batch. ``aux`` holds the scalars of the
family: ``theta`` for the negative binomials, ``nu`` and ``gamma`` for the t family.
"""

from __future__ import annotations

import math

import numpy as np


def lgamma_counts(y: np.ndarray, shift: float) -> np.ndarray:
    """``lgamma(y + shift)`` through the distinct values of ``y``, of which counts have few."""
    values, where = np.unique(y, return_inverse=True)
    return np.array([math.lgamma(v + shift) for v in values])[where]


def cloglog(y, eta, aux, z):
    e = np.exp(np.clip(eta, -30.0, 3.5))
    mu = -np.expm1(-e)
    return y * np.log(mu) - (1 - y) * e, e * (y - mu) / mu, e * e * (1 - mu) / mu


def logit(y, eta, aux, z):
    p = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
    return y * np.log(p) + (1 - y) * np.log1p(-p), y - p, p * (1 - p)


def poisson(y, eta, aux, z):
    mu = np.exp(np.clip(eta, -30, 30))
    return y * eta - mu - lgamma_counts(y, 1.0), y - mu, mu


def gaussian(y, eta, aux, z):
    s2 = aux["sigma"] ** 2
    r = y - eta
    return -0.5 * (r * r / s2 + math.log(2 * math.pi * s2)), r / s2, np.full(len(y), 1 / s2)


def _nb_loglik(y, mu, theta):
    return (
        lgamma_counts(y, theta)
        - math.lgamma(theta)
        - lgamma_counts(y, 1.0)
        + theta * np.log(theta / (theta + mu))
        + np.where(y > 0, y * np.log(np.maximum(mu, 1e-300) / (theta + mu)), 0.0)
    )


def nbinom(y, eta, aux, z):
    theta, mu = aux["theta"], np.exp(np.clip(eta, -30, 30))
    shrink = theta / (theta + mu)
    return _nb_loglik(y, mu, theta), (y - mu) * shrink, mu * shrink


def nbinom_identity(y, eta, aux, z):
    theta, bad = aux["theta"], eta <= 0
    mu = np.where(bad, 1.0, eta)
    variance = mu * (1 + mu / theta)
    ll = np.where(bad, -np.inf, _nb_loglik(y, mu, theta))
    return ll, np.where(bad, 0.0, (y - mu) / variance), np.where(bad, 1e-12, 1 / variance)


def truncated_nbinom(y, eta, aux, z):
    """NB2 given a positive count."""
    theta, eta = aux["theta"], np.clip(eta, -15, 30)

    def score(eta_):
        mu = np.exp(eta_)
        p0 = np.exp(-theta * np.log1p(mu / theta))
        tail = -np.expm1(-theta * np.log1p(mu / theta))
        return (y - mu) * theta / (theta + mu) - mu * p0 / ((1 + mu / theta) * tail)

    mu, h = np.exp(eta), 1e-4
    ll = _nb_loglik(y, mu, theta) - np.log(-np.expm1(-theta * np.log1p(mu / theta)))
    curvature = (score(eta - h) - score(eta + h)) / (2 * h)
    return ll, score(eta), np.maximum(curvature, 1e-8)


def student(y, eta, aux, z):
    """t errors with log scale ``gamma0 + gamma1 * z``."""
    nu, (g0, g1) = aux["nu"], aux["gamma"]
    log_s = g0 + g1 * z
    s2 = np.exp(2 * log_s)
    r = y - eta
    q = r * r / (nu * s2)
    const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
    pull = (nu + 1) / ((nu * s2) * (1 + q))
    return const - log_s - (nu + 1) / 2 * np.log1p(q), pull * r, (nu + 1) / ((nu + 3) * s2)


def _digamma_and_slope(x: float) -> tuple[float, float]:
    """The first two derivatives of lgamma: recurrence up to 8, asymptotic series from there."""
    first = second = 0.0
    while x < 8:
        first, second, x = first - 1 / x, second + 1 / (x * x), x + 1
    r = 1 / (x * x)
    first += math.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    second += 1 / x + 0.5 * r + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66))))
    return first, second


def nu_constants(nu: float) -> tuple[float, float]:
    """Derivatives in log nu of the constant of the t law."""
    (d1, t1), (d0, t0) = _digamma_and_slope((nu + 1) / 2), _digamma_and_slope(nu / 2)
    slope = nu / 2 * (d1 - d0) - 0.5
    return slope, nu / 2 * (d1 - d0) + nu * nu / 4 * (t1 - t0)


def cloglog_score(y, eta, aux, z):
    e = np.exp(np.clip(eta, -30.0, 3.5))
    mu = -np.expm1(-e)
    return e * (y - mu) / mu, e * e * (1 - mu) / mu


def student_score(y, eta, aux, z):
    nu, (g0, g1) = aux["nu"], aux["gamma"]
    s2 = np.exp(2 * (g0 + g1 * z))
    r = y - eta
    return (nu + 1) * r / (nu * s2 + r * r), (nu + 1) / ((nu + 3) * s2)


# Score and weight alone, where they cost much less than the likelihood.
SCORES = {"cloglog": cloglog_score, "student": student_score}

FAMILIES = {
    "cloglog": cloglog,
    "logit": logit,
    "poisson": poisson,
    "gaussian": gaussian,
    "nbinom": nbinom,
    "nbinom_identity": nbinom_identity,
    "truncated_nbinom": truncated_nbinom,
    "student": student,
}

# Scalars tuned along the way: family -> (name, bounds on its log).
SHAPE = {
    "nbinom": ("theta", (-6.0, 9.0)),
    "nbinom_identity": ("theta", (-6.0, 9.0)),
    "truncated_nbinom": ("theta", (-6.0, 9.0)),
    "student": ("nu", (0.1, 6.0)),
}

LINK_MEAN = {
    "cloglog": lambda e: -np.expm1(-np.exp(e)),
    "logit": lambda e: 1 / (1 + np.exp(-e)),
    "poisson": np.exp,
    "nbinom": np.exp,
    "truncated_nbinom": np.exp,
    "nbinom_identity": lambda e: e,
    "gaussian": lambda e: e,
    "student": lambda e: e,
}
