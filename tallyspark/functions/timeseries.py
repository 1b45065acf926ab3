"""Forecasts of one series three steps ahead, each with an 80% band, from many origins at once; NumPy only.

A model takes rows `y` (one a training size, padded with zeros) and their ascending sizes `n`, and returns an array
(rows, 3, 3): mean, low and high by step. Weights are searched on grids that narrow around their best point, for all
rows together, so equal input gives equal output. Values should be near one; `scaled` sees to that.
"""

from __future__ import annotations

import numpy as np

Z80 = 1.2815515655446004
STEPS = np.arange(1, 4)
SEASON = 12
LEAST = 13


def band(mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return np.stack((mean, mean - Z80 * sd, mean + Z80 * sd), axis=1)


def _each(y, n, f):
    """A model that looks at one row at a time; f returns its mean and standard deviation by step."""
    mean, sd = zip(*(f(row[:size]) for row, size in zip(y, n)))
    return band(np.array(mean), np.array(sd))


def naive(y, n):
    return _each(y, n, lambda v: (np.full(3, v[-1]), np.sqrt(np.mean(np.diff(v) ** 2) * STEPS)))


def drift(y, n):
    def one(v):
        m = len(v) - 1
        slope = (v[-1] - v[0]) / m
        sd = np.sqrt(np.sum((np.diff(v) - slope) ** 2) / max(m - 1, 1))
        return v[-1] + slope * STEPS, sd * np.sqrt(STEPS * (1 + STEPS / m))

    return _each(y, n, one)


def seasonal(y, n):
    """The value a year before; needs 13 values."""
    return _each(y, n, lambda v: (v[-SEASON:][:3], np.full(3, np.sqrt(np.mean((v[SEASON:] - v[:-SEASON]) ** 2)))))


def _search(loss, bounds, sizes, rows, rounds=3):
    """For each row the point of least loss: a grid over the bounds, then smaller ones around the best point."""
    axes = [np.tile(np.linspace(lo, hi, m), (rows, 1)) for (lo, hi), m in zip(bounds, sizes)]
    for _ in range(rounds + 1):
        shaped = [a.reshape(rows, *(-1 if i == k else 1 for i in range(len(axes)))) for k, a in enumerate(axes)]
        grid = [g.reshape(rows, -1) for g in np.broadcast_arrays(*shaped)]
        at = np.argmin(np.nan_to_num(loss(*grid), nan=np.inf), axis=1)[:, None]
        best = [np.take_along_axis(g, at, 1) for g in grid]
        wide = [a[:, 1:2] - a[:, :1] for a in axes]
        ends = [(np.maximum(lo, p - w), np.minimum(hi, p + w)) for p, w, (lo, hi) in zip(best, wide, bounds)]
        axes = [a + (z - a) * np.linspace(0, 1, 5) for a, z in ends]
    return best


def _smooth(y, n, alpha, beta, phi, trend):
    """Damped-trend smoothing with its starting states by least squares: (squared errors, level, slope) of each weight.

    Errors are linear in the starting states, so three runs at once give them: the data from zero states, and the two unit states.
    """
    shape = np.broadcast_shapes(alpha.shape, beta.shape, phi.shape)
    level, slope, gram = np.zeros((3, *shape)), np.zeros((3, *shape)), np.zeros((3, 3, *shape))
    level[1], slope[2] = 1.0, 1.0
    alpha, beta, phi = (np.broadcast_to(v, shape) for v in (alpha, beta, phi))
    for t in range(n[-1]):
        on = slice(np.searchsorted(n, t, side="right"), None)
        ahead = level[:, on] + phi[on] * slope[:, on]
        miss = -ahead
        miss[0] += y[on, t, None]
        for i in range(3):
            for j in range(i, 3):
                gram[i, j, on] += miss[i] * miss[j]
        level[:, on] = ahead + alpha[on] * miss
        slope[:, on] = phi[on] * slope[:, on] + beta[on] * miss
    if trend:
        a, b, c, p, q = gram[1, 1], gram[1, 2], gram[2, 2], gram[0, 1], gram[0, 2]
        det = np.maximum(a * c - b * b, 1e-14)
        first, second = (b * q - c * p) / det, (b * p - a * q) / det
    else:
        first, second = -gram[0, 1] / np.maximum(gram[1, 1], 1e-14), np.zeros(shape)
    own = np.stack((np.ones(shape), first, second))
    sse = sum(own[i] * own[j] * gram[i, j] * (1 if i == j else 2) for i in range(3) for j in range(i, 3))
    return np.maximum(sse, 0), (own * level).sum(0), (own * slope).sum(0)


def damped(y, n):
    """Additive errors and a damped additive trend; damping between 0.8 and 0.98."""
    fit = lambda a, share, f: _smooth(y, n, a, a * share, f, True)
    a, share, f = _search(lambda *w: fit(*w)[0], [(1e-4, 0.9999), (1e-4, 0.9999), (0.8, 0.98)], (10, 6, 4), len(y))
    sse, level, slope = fit(a, share, f)
    reach = np.cumsum(f**STEPS, axis=1)
    gain = np.concatenate((np.ones_like(a), (a + a * share * reach[:, :2])), axis=1)
    return band(level + slope * reach, np.sqrt(sse / n[:, None] * np.cumsum(gain**2, axis=1)))


def _indices(v: np.ndarray) -> np.ndarray | None:
    """Multiplicative indices of the months, where the autocorrelation at a year is significant at 90%."""
    c = v - v.mean()
    r = np.array([c[k:] @ c[:-k] for k in range(1, SEASON + 1)]) / max(c @ c, 1e-300)
    if v.min() <= 0 or abs(r[-1]) <= 1.645 * np.sqrt((1 + 2 * np.sum(r[:-1] ** 2)) / len(v)):
        return None
    half = np.r_[0.5, np.ones(SEASON - 1), 0.5] / SEASON
    ratio = v[SEASON // 2 : -(SEASON // 2)] / np.convolve(v, half, "valid")
    month = (np.arange(len(ratio)) + SEASON // 2) % SEASON
    index = np.bincount(month, ratio, SEASON) / np.bincount(month, minlength=SEASON)
    return index / index.mean()


def theta(y, n):
    """Simple smoothing plus half the slope of the trend line; from three years on without the season, if there is one."""
    y = y.copy()
    back = np.ones((len(y), 3))
    for row, size in enumerate(n):
        index = _indices(y[row, :size]) if size >= 3 * SEASON else None
        if index is not None:
            y[row, :size] /= index[np.arange(size) % SEASON]
            back[row] = index[(size + np.arange(3)) % SEASON]
    fit = lambda a: _smooth(y, n, a, np.zeros(1), np.zeros(1), False)
    (a,) = _search(lambda w: fit(w)[0], [(0.01, 0.99)], (40,), len(y))
    sse, level, _ = fit(a)
    slope = np.array([[np.polyfit(np.arange(size), row[:size], 1)[0]] for row, size in zip(y, n)])
    mean = level + slope / 2 * (STEPS - 1 + (1 - (1 - a) ** n[:, None]) / a)
    return band(mean * back, np.sqrt(sse / n[:, None] * (1 + (STEPS - 1) * a**2)) * back)


def _arma(z, n, phi, theta):
    """Exact likelihood of ARMA(1, 1) errors with the regressors z[1:], by the innovations recursion, for each weight.

    Returns (-2 log likelihood, coefficients, variance, next value of each row of z).
    """
    k, shape = len(z), np.broadcast_shapes(phi.shape, theta.shape)
    phi, theta = np.broadcast_to(phi, shape), np.broadcast_to(theta, shape)
    ahead, gram, logs = np.zeros((k, *shape)), np.zeros((k, k, *shape)), np.zeros(shape)
    r = (1 + 2 * phi * theta + theta**2) / (1 - phi**2)
    for t in range(n[-1]):
        on = slice(np.searchsorted(n, t, side="right"), None)
        now = z[:, on, t, None]
        miss = now - ahead[:, on]
        for i in range(k):
            for j in range(i, k):
                gram[i, j, on] += miss[i] * miss[j] / r[on]
        logs[on] += np.log(r[on])
        ahead[:, on] = phi[on] * now + theta[on] / r[on] * miss
        r[on] = 1 + theta[on] ** 2 - theta[on] ** 2 / r[on]
    gram = np.moveaxis(gram, (0, 1), (-2, -1))
    gram = gram + np.swapaxes(np.triu(gram, 1), -2, -1)
    inner = gram[..., 1:, 1:]
    weight = np.linalg.solve(inner + 1e-10 * np.eye(k - 1), gram[..., 1:, :1])[..., 0]
    sse = gram[..., 0, 0] - np.sum(weight * gram[..., 1:, 0], axis=-1)
    var = np.maximum(sse, 1e-14) / n[:, None]
    return n[:, None] * (np.log(2 * np.pi * var) + 1) + logs, weight, var, ahead


#: Autoregressive and moving-average orders of the differences.
ORDERS = ((0, 0), (1, 0), (0, 1), (1, 1))


def _arima(y, n, x=None, coming=None):
    """One difference, a drift and the order of the least corrected information criterion."""
    d = np.diff(y, axis=1)
    rows, m = len(y), n - 1
    ones = np.ones_like(d)
    z = np.stack((d, ones) if x is None else (d, ones, np.diff(x, axis=1)))
    later = np.ones((rows, 3, 1)) if x is None else np.stack((np.ones((rows, 3)), coming), axis=2)
    best, out = np.full(rows, np.inf), np.zeros((rows, 3, 3))
    last = y[np.arange(rows), n - 1][:, None]
    for p, q in ORDERS:
        free = [i for i, on in enumerate((p, q)) if on]
        place = lambda *w: [w[free.index(i)] if i in free else np.zeros((rows, 1)) for i in range(2)]  # noqa: B023, E731
        w = _search(lambda *g: _arma(z, m, *place(*g))[0], [(-0.98, 0.98)] * len(free), (41,) if len(free) == 1 else (15, 15), rows) if free else []
        phi, theta_ = place(*w)
        loss, weight, var, ahead = _arma(z, m, phi, theta_)
        count = p + q + 1 + weight.shape[-1]
        score = loss[:, 0] + 2 * count + 2 * count * (count + 1) / np.maximum(m - count - 1, 1)
        first = ahead[0, :, 0] - np.sum(weight[:, 0] * ahead[1:, :, 0].T, axis=1)
        step = np.einsum("rhk,rk->rh", later, weight[:, 0]) + first[:, None] * phi ** (STEPS - 1)
        psi = np.concatenate((np.ones((rows, 1)), phi ** np.arange(2) * (phi + theta_)), axis=1)
        got = band(last + np.cumsum(step, axis=1), np.sqrt(var * np.cumsum(np.cumsum(psi, axis=1) ** 2, axis=1)))
        better = score < best
        out[better], best = got[better], np.where(better, score, best)
    return out


def arima(y, n):
    return _arima(y, n)


def arima_with(y, n, x, lag=3):
    """The same with the outer series `x` of `lag` months ago as a regressor; the first `lag` values leave the training."""
    size = y.shape[1] - lag
    known = np.tile(x[:size], (len(y), 1))
    coming = np.array([np.diff(x[s - lag - 1 : s - lag + 3]) for s in n])
    return _arima(y[:, lag:], n - lag, known, coming)


def additive(y, n):
    """A piecewise-linear trend with sparse slope changes and, from two years on, a yearly season, by its posterior mode.

    Changes have a double exponential prior of scale 0.01 on a series of height and length one, met by reweighted least squares.
    """
    out = []
    for row, size in zip(y, n):
        top = max(np.abs(row[:size]).max(), 1e-300)
        v, t = row[:size] / top, np.arange(size + 3) / (size - 1)
        knots = t[np.linspace(0, int(0.8 * size) - 1, min(25, int(0.8 * size) - 1) + 1).round().astype(int)[1:]]
        waves = [f(2 * np.pi * j * np.arange(size + 3) / SEASON) for j in range(1, 6) for f in (np.sin, np.cos)] if size >= 2 * SEASON else []
        x = np.column_stack((np.ones_like(t), t, *(np.maximum(0, t - k) for k in knots), *waves))
        gram, right = x[:size].T @ x[:size], x[:size].T @ v
        prior = np.r_[0.04, 0.04, np.zeros(len(knots)), np.full(len(waves), 0.01)]
        change, var = np.full(len(knots), 0.1), v.var() + 1e-8
        for _ in range(8):
            prior[2 : 2 + len(knots)] = 1 / (0.01 * np.maximum(np.abs(change), 1e-6))
            w = np.linalg.solve(gram + np.diag(prior * var), right)
            change, var = w[2 : 2 + len(knots)], max(np.mean((v - x[:size] @ w) ** 2), 1e-10)
        ahead = STEPS / (size - 1)
        trend = 2 * np.mean(np.abs(change)) ** 2 * len(knots) * ahead**3 / 3
        out.append(band((x[size:] @ w)[None] * top, np.sqrt(var + trend)[None] * top)[0])
    return np.array(out)


#: Candidates of one series; "arima_rate" also reads the policy rate.
MODELS = {"naive": naive, "drift": drift, "seasonal": seasonal, "theta": theta, "damped": damped, "arima": arima, "arima_rate": arima_with, "additive": additive}
#: All of them, from the simplest on; a tie goes to the simpler one.
CANDIDATES = (*MODELS, "combination", "boosted")
MEMBERS = ("drift", "damped", "boosted")


def scaled(name: str, y: np.ndarray, n: np.ndarray, rate: np.ndarray | None = None) -> np.ndarray:
    """A model's forecasts with each row divided by its mean."""
    height = np.array([[abs(row[:size].mean()) or 1.0] for row, size in zip(y, n)])
    more = (rate,) if name == "arima_rate" else ()
    return MODELS[name](y / height, n, *more) * height[:, :, None]


def without_step(y: np.ndarray, at: int | None) -> np.ndarray:
    """The series with the months before the break lifted by its step: the excess of that month's rate of change over the median of the others."""
    if at is None or not 2 <= at < len(y) or np.any(y[:-1] <= 0):
        return y.astype(float)
    change = np.diff(y) / y[:-1]
    step = (change[at - 1] - np.median(np.delete(change, at - 1))) * y[at - 1]
    return np.where(np.arange(len(y)) < at, y + step, y)


def adjusted(y: np.ndarray, n: np.ndarray, at: int | None) -> np.ndarray:
    """One padded row a training size, each without the step as that training knows it."""
    out = np.zeros((len(n), n[-1]))
    for row, size in zip(out, n):
        row[:size] = without_step(y[:size], at)
    return out


def boost(codes: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = 100, depth: int = 3, rate: float = 0.1, least: int = 20, ridge: float = 1.0) -> np.ndarray:
    """Gradient-boosted trees on binned columns with squared loss: fitted where w > 0, returned for every row."""
    rows, columns = codes.shape
    bins = int(codes.max()) + 1
    place = codes + bins * np.arange(columns)
    known = np.repeat(w > 0, columns)
    heavy = np.repeat(w, columns)
    out = np.full(rows, np.average(y, weights=w))
    for _ in range(trees):
        pull, node = w * (y - out), np.zeros(rows, np.int64)
        wide = np.repeat(pull, columns)
        for level in range(depth):
            nodes = 2**level
            cell = (place + (node * columns * bins)[:, None]).ravel()
            g, m, c = (np.bincount(cell, v, nodes * columns * bins).reshape(nodes, columns, bins).cumsum(2) for v in (wide, heavy, known))
            total, mass = g[:, :, -1:], m[:, :, -1:]
            gain = g**2 / (m + ridge) + (total - g) ** 2 / (mass - m + ridge) - total**2 / (mass + ridge)
            gain[(c < least) | (c[:, :, -1:] - c < least)] = 0
            gain = gain.reshape(nodes, -1)
            best = gain.argmax(1)
            cut = np.where(gain[np.arange(nodes), best] > 0, best % bins, bins)
            node = 2 * node + (codes[np.arange(rows), (best // bins)[node]] > cut[node])
        g, m = np.bincount(node, pull, 2**depth), np.bincount(node, w, 2**depth)
        out = out + rate * (g / (m + ridge))[node]
    return out


def _columns(logs: np.ndarray, month: np.ndarray, rate: np.ndarray, t: int, h: int) -> np.ndarray:
    back = min(t, SEASON)
    size = np.ones(len(logs))
    steps = [logs[:, t - j] - logs[:, t - j - 1] for j in range(3)]
    return np.column_stack((*steps, (logs[:, t] - logs[:, t - back]) / back, size * ((month[t] - 1 + h) % SEASON + 1), logs[:, t], size * rate[t], size * (rate[t] - rate[t - 3])))


def boosted(values: np.ndarray, month: np.ndarray, rate: np.ndarray, at: int | None) -> np.ndarray:
    """One model a step over all series: (series, 3). Examples across the break are left out and weigh by their size.

    A series with a month without an amount stays out and repeats its last value.
    """
    n = values.shape[1]
    out = np.repeat(values[:, -1:], 3, axis=1)
    active = np.flatnonzero((values > 0).all(1))
    if not len(active):
        return out
    v = values[active]
    logs = np.log(v)
    for h in range(1, 4):
        times = [t for t in range(3, n - h) if at is None or not t < at <= t + h]
        if not times:
            continue
        x = np.vstack([_columns(logs, month, rate, t, h) for t in (*times, n - 1)])
        y = np.concatenate([*(logs[:, t + h] - logs[:, t] for t in times), np.zeros(len(v))])
        w = np.concatenate([*(v[:, t] for t in times), np.zeros(len(v))])
        old = x[: -len(v)]
        codes = np.column_stack([np.searchsorted(np.unique(np.quantile(old[:, f], np.linspace(0, 1, 33)[1:-1])), x[:, f]) for f in range(x.shape[1])])
        out[active, h - 1] = v[:, -1] * np.exp(boost(codes, y, w / w[w > 0].mean())[-len(v) :])
    return out


def boosted_bands(y: np.ndarray, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bands from the relative errors at origins that had ended by then, with fewer than four from the changes; no step's is narrower than the one before."""
    out = []
    for size, own in zip(n, mean):
        past = [i for i, m in enumerate(n) if m + 3 <= size]
        if len(past) >= 4:
            wide = [np.quantile([abs(y[n[i] + h] / mean[i][h] - 1) if mean[i][h] else 0.0 for i in past], 0.8) for h in range(3)]
        else:
            old = y[:size]
            change = np.diff(old) / np.where(old[:-1] == 0, np.nan, old[:-1])
            wide = Z80 * (np.nanstd(change) if np.isfinite(change).any() else 0.0) * np.sqrt(STEPS)
        wide = np.maximum.accumulate(wide)
        out.append(np.stack((own, own * (1 - wide), own * (1 + wide))))
    return np.array(out)
