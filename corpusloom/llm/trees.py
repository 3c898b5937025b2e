"""Small decision trees over columns of numbers, for bounded training sets on the driver."""

from __future__ import annotations

#: Thresholds that are tried for a feature.
CUTS = 32


def cuts(x):
    """For each feature, the thresholds between its quantiles."""
    import numpy as np

    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > CUTS:
            values = np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 1), method="lower"))
        out.append((values[:-1] + values[1:]) / 2)
    return out


def grow(x, y, weight, thresholds, depth: int, features: int, rng, least: int = 5):
    """A regression tree of y: (feature, threshold, below, above) or a leaf's number. At each
    node, so many features are tried; the split with the least squared error stands."""
    import numpy as np

    total = weight.sum()
    mean = float((weight * y).sum() / total) if total else 0.0
    if depth == 0 or len(y) < 2 * least or np.ptp(y) == 0:
        return mean
    best = (1e-9 * total, None, None)
    for f in rng.permutation(x.shape[1])[:features]:
        where = np.searchsorted(thresholds[f], x[:, f], side="left")
        n = len(thresholds[f]) + 1
        if n == 1:
            continue
        w, s, k = np.bincount(where, weight, n).cumsum()[:-1], np.bincount(where, weight * y, n).cumsum()[:-1], np.bincount(where, minlength=n).cumsum()[:-1]
        ok = (k >= least) & (len(y) - k >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, s**2 / w + (total * mean - s) ** 2 / (total - w) - total * mean**2, -1)
        i = int(np.nanargmax(gain))
        if gain[i] > best[0]:
            best = (float(gain[i]), int(f), float(thresholds[f][i]))
    _, f, at = best
    if f is None:
        return mean
    low = x[:, f] <= at
    return f, at, *[grow(x[m], y[m], weight[m], thresholds, depth - 1, features, rng, least) for m in (low, ~low)]


def predict(tree, x):
    import numpy as np

    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, at, below, above = tree
    low = x[:, f] <= at
    out = np.empty(len(x))
    out[low], out[~low] = predict(below, x[low]), predict(above, x[~low])
    return out


def paths(tree, before=()):
    """Every node but the root as a conjunction of (feature, at most?, threshold)."""
    if isinstance(tree, tuple):
        f, at, below, above = tree
        for low, child in ((True, below), (False, above)):
            here = (*before, (f, low, at))
            yield here
            yield from paths(child, here)
