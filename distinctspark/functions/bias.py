"""Expected bias of the raw HyperLogLog estimate, from the distribution of its registers.

With Poisson(n) values over m registers the registers are independent, each at most k with
probability exp(-n / m * 2^-k).  The raw estimate is a * m^2 / Z with Z the sum of 2^-register, and
1 / Z is the integral of exp(-t * Z) over t >= 0, so its mean is the integral of phi(t)^m where
phi(t) = E[exp(-t * 2^-register)].  Gauss-Laguerre quadrature gives it to many digits.  A fixed n
differs from a Poisson one by half of n times the second derivative.
"""

from __future__ import annotations

import functools

import numpy as np

#: Points per precision, evenly spaced in n from 0 to REACH * m.
POINTS = 200
REACH = 5.2
_NODES, _WEIGHTS = np.polynomial.laguerre.laggauss(64)
#: Precisions the correction exists for.
LEAST_P, MOST_P = 4, 18

# Linear counting is used below these estimates, for p = 4, 5, ..., 18.
LINEAR_BELOW = (
    10, 20, 40, 80, 220, 400, 900, 1800, 3100, 6500, 15500, 20000, 50000, 120000, 350000,
)


def _mean_inverse(per_register: np.ndarray, m: int) -> np.ndarray:
    """E[1 / Z] for each mean number of values per register."""
    k = np.arange(65)
    value = 2.0**-k
    at_most = np.exp(-per_register[:, None] * value)
    share = np.diff(at_most, axis=1, prepend=0.0)
    mean = m * (share @ value)
    t = _NODES / mean[:, None]
    phi = np.einsum("nk,nqk->nq", share, np.exp(-t[:, :, None] * value))
    return np.exp(m * np.log(phi) + _NODES + np.log(_WEIGHTS)).sum(1) / mean


@functools.cache
def bias_table(p: int, alpha: float) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """(raw estimates, their biases) for rising cardinalities; ``alpha`` is the raw estimate's factor."""
    m = 1 << p
    step = REACH * m / (POINTS - 1)
    n = np.arange(-1, POINTS + 1) * step
    mean = alpha * m * m * _mean_inverse(np.maximum(n, 0) / m, m)
    bend = np.zeros(POINTS)
    bend[1:] = (mean[3:] - 2 * mean[2:-1] + mean[1:-2]) / step**2
    raw = mean[1:-1] - n[1:-1] / 2 * bend
    return tuple(map(float, raw)), tuple(map(float, raw - n[1:-1]))
