"""Linear fits from one matrix of sums: ridge over any block set, Huber loss with a fixed delta, censored regression.

Every pass over the rows is one aggregate: each task adds up z z' of its rows, z = (features, 1, target), and Spark adds the tasks'
matrices row by row. What reaches the driver is (D + 2)^2 numbers, whatever the rows. Numpy serves inside tasks only for that product.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from .. import registry as R

#: Reweighting rounds of the Huber fit before Newton steps.
REWEIGHTED = 5
#: Of a batch's features and targets: a weight of each row's z z', and a factor of each row's z, summed apart.
RowTerms = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]]


def _plain(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    return np.ones(len(y)), np.zeros(len(y)), 0.0


def moments(df: DataFrame, features: str, y: str, terms: RowTerms = _plain) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums over all rows: weight z z' (z = features, 1, y), factor z, and a scalar. A null target or a null vector fails."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("x")
            if cells.null_count or batch.column("y").null_count:
                raise ValueError("a row without features or target")
            x = cells.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            target = batch.column("y").to_numpy(zero_copy_only=False)
            weight, factor, scalar = terms(x, target)
            z = np.column_stack((x, np.ones(len(target)), target))
            # one more row for the factors and one number more for the scalar
            part = np.zeros((z.shape[1] + 1, z.shape[1] + 1))
            part[:-1, :-1] = (z * weight[:, None]).T @ z
            part[-1, :-1] = factor @ z
            part[-1, -1] = scalar
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    rows = df.select(vector_to_array(features).alias("x"), F.col(y).cast("double").alias("y"))
    summed = rows.mapInArrow(run, "i long, row array<double>").groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("s"))
    found = sorted(((r["i"], r["s"]) for r in summed.select("i", vector_to_array("s").alias("s")).collect()), key=lambda r: r[0])
    if not found:
        raise ValueError("no rows to fit")
    table = np.array([r[1] for r in found])
    return table[:-1, :-1], table[-1, :-1], float(table[-1, -1])


@dataclass(frozen=True)
class LinearFit:
    """Coefficients, intercept, and what the kind of fit adds."""
    coefficients: np.ndarray
    intercept: float
    sigma: float | None = None
    errors: np.ndarray | None = None  # standard errors of coefficients, intercept and sigma
    gradient: float = 0.0
    passes: int = 1
    history: list = field(default_factory=list)

    def predict(self, features: str) -> Column:
        """The prediction as a column: a dot product in the JVM."""
        beta = F.array(*[F.lit(float(b)) for b in self.coefficients])
        products = F.zip_with(vector_to_array(F.col(features)), beta, lambda x, b: x * b)
        return F.aggregate(products, F.lit(float(self.intercept)), lambda total, p: total + p)


def _centred(sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means, and population covariances of (features, y)."""
    d = len(sums) - 2
    keep = [*range(d), d + 1]
    n = sums[d, d]
    mean = sums[d, keep] / n
    return n, mean, sums[np.ix_(keep, keep)] / n - np.outer(mean, mean)


def ridge(sums: np.ndarray, columns: Sequence[int] | None = None, penalty: float = 1e-2) -> LinearFit:
    """Least squares on standardized features and target with a squared penalty, from the sums alone; a constant feature gets 0.

    `columns` picks features, so one pass serves every block set. The penalty counts as in Spark's own normal-equation solver.
    """
    n, mean, cov = _centred(sums)
    d = len(mean) - 1
    columns = np.arange(d) if columns is None else np.asarray(columns, int)
    scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
    used = columns[scale[columns] > 1e-9 * np.maximum(1.0, np.abs(mean[columns]))]
    beta, target = np.zeros(d), scale[d]
    if len(used) and target > 0:
        s = scale[used]
        a = cov[np.ix_(used, used)] / np.outer(s, s) + penalty / target * np.eye(len(used))
        b = cov[used, d] / s
        beta[used] = (np.linalg.lstsq(a, b, rcond=None)[0] if penalty == 0 else np.linalg.solve(a, b)) / s
    return LinearFit(beta, float(mean[d] - mean[:d] @ beta))


def fit_metrics(sums: np.ndarray, fit: LinearFit) -> tuple[int, float | None, float]:
    """n, R2 and RMSE of a fit on the rows of `sums`, without reading them again."""
    n, mean, cov = _centred(sums)
    d = len(mean) - 1
    b = fit.coefficients
    bias = mean[d] - mean[:d] @ b - fit.intercept
    square = max(cov[d, d] - 2 * b @ cov[:d, d] + b @ cov[:d, :d] @ b, 0.0) + bias * bias
    return int(n), (1.0 - square / cov[d, d] if cov[d, d] > 0 else None), math.sqrt(square)


def ablation(df: DataFrame, blocks: Mapping[str, int], configs: Mapping[str, Sequence[str]], features: str, y: str = "y", split: str = "split",
             penalty: float = 1e-2) -> list[tuple[str, int, int, float | None, float]]:
    """(config, dim, n, r2, rmse) on test rows for block combinations of one vector column; two passes, whatever the number of configurations.

    `blocks` names the widths of the parts of the vector, in order.
    """
    starts, at = {}, 0
    for name, width in blocks.items():
        starts[name], at = at, at + width
    train = moments(df.where(F.col(split) == "train"), features, y)[0]
    test = moments(df.where(F.col(split) == "test"), features, y)[0]
    out = []
    for name, parts in configs.items():
        columns = [c for p in parts for c in range(starts[p], starts[p] + blocks[p])]
        out.append((name, len(columns), *fit_metrics(test, ridge(train, columns, penalty))))
    return out


# ---- Huber --------------------------------------------------------------------------------------------------------

def huber_fit(df: DataFrame, features: str, y: str = "y", delta: float = R.HUBER_DELTA, penalty: float = 0.0, tolerance: float = 1e-8, most: int = 60) -> LinearFit:
    """Minimizes the mean Huber loss of fixed `delta` plus penalty/2 times the squared standardized coefficients.

    A round is one aggregate. The first rounds reweight: rows with a residual beyond delta weigh delta / |residual|, and each lowers the loss. Then
    Newton steps on the rows inside delta end in a few rounds; a step that does not lower the loss is halved. Ends when the largest component of the
    gradient, in units of the features' deviations, is under `tolerance`; without that after `most` rounds the fit fails.
    """
    sums = moments(df, features, y)[0]
    n, mean, cov = _centred(sums)
    d = len(mean) - 1
    scale = np.sqrt(np.maximum(np.diag(cov)[:d], 0.0))
    used = np.flatnonzero(scale > 1e-9 * np.maximum(1.0, np.abs(mean[:d])))
    at, units = [*used, d], np.append(scale[used], 1.0)
    shrink = penalty * np.append(scale[used] ** 2, 0.0)
    start = ridge(sums, None, penalty)
    theta, step, last, history = np.append(start.coefficients[used], start.intercept), None, None, []
    for passes in range(2, most + 2):
        beta, intercept, reweight = np.zeros(d), theta[-1], passes <= REWEIGHTED + 1
        beta[used] = theta[:-1]

        def terms(x, target):
            residual = target - x @ beta - intercept
            size = np.abs(residual)
            inside = size <= delta
            loss = np.where(inside, 0.5 * size ** 2, delta * (size - 0.5 * delta))
            outer = delta / np.maximum(size, delta) if reweight else 0.0
            return np.where(inside, 1.0, outer), np.clip(residual, -delta, delta), float(loss.sum())
        matrix, pull, loss = moments(df, features, y, terms)
        loss = loss / n + 0.5 * float(shrink @ theta ** 2)
        if last is not None and not reweight and loss > last[1] + 1e-13 * abs(last[1]):
            step = 0.5 * step
            theta = last[0] + step
            continue
        g = pull[at] / n - shrink * theta
        gradient = float(np.abs(g / units).max())
        history.append((passes, loss, gradient))
        if gradient < tolerance:
            return LinearFit(beta, float(intercept), gradient=gradient, passes=passes, history=history)
        # in units of the features, with a trace of the plain matrix where few rows are inside
        a = (matrix[np.ix_(at, at)] / n + np.diag(shrink)) / np.outer(units, units)
        step = np.linalg.lstsq(a + 1e-10 * np.eye(len(a)), g / units, rcond=None)[0] / units
        last, theta = (theta, loss), theta + step
    raise RuntimeError(f"the Huber fit did not converge in {most} rounds")


# ---- censored regression --------------------------------------------------------------------------------------------

_erfc = np.vectorize(math.erfc, otypes=[float])


def _mills(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """density / CDF and log CDF of the normal distribution; far below 0 by their expansions."""
    low = np.minimum(z, -30.0)
    cdf = 0.5 * _erfc(-np.maximum(z, -30.0) / math.sqrt(2.0))
    pdf = np.exp(-0.5 * np.maximum(z, -30.0) ** 2) / math.sqrt(2.0 * math.pi)
    far = z < -30.0
    return (np.where(far, -low / (1.0 - 1.0 / low ** 2 + 3.0 / low ** 4), pdf / cdf),
            np.where(far, -0.5 * low ** 2 - np.log(-low) - 0.5 * math.log(2.0 * math.pi), np.log(cdf)))


def tobit_fit(df: DataFrame, features: str, y: str = "y", floor: float = R.FLOOR, tolerance: float = 1e-8, most: int = 30) -> LinearFit:
    """Linear regression left-censored at `floor`, by Newton's method on the concave form of the likelihood (coefficients and 1 over sigma, both
    divided by sigma), with standard errors from the information matrix.

    A step is one aggregate that returns the gradient, the information and the likelihood; a step that lowers the likelihood is halved. Ends when
    the largest component of the mean gradient is under `tolerance`; without that after `most` passes the fit fails. Constant features get 0.
    """
    target = F.col(y).cast("double")
    rows = df.select(features, F.when(target <= floor + R.FLOOR_TOLERANCE, F.lit(float(floor))).otherwise(target).alias("__y"))
    sums, free, _ = moments(rows, features, "__y", lambda x, t: (np.ones(len(t)), (t > floor).astype(float), 0.0))
    n, mean, cov = _centred(sums)
    d = len(mean) - 1
    free = free[d]
    scale = np.sqrt(np.maximum(np.diag(cov)[:d], 0.0))
    used = np.flatnonzero(scale > 1e-9 * np.maximum(1.0, np.abs(mean[:d])))
    at, units = [*used, d, d + 1], np.append(scale[used], [1.0, max(math.sqrt(max(cov[d, d], 0.0)), 1e-12)])
    start = ridge(sums, None, 0.0)
    sigma = max(fit_metrics(sums, start)[2], 1e-6 * units[-1])
    # slopes and intercept over sigma, then -1 / sigma, which goes with the last of z = (x, 1, y)
    theta = np.append(start.coefficients[used], [start.intercept, -1.0]) / sigma

    def evaluate(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        slopes, intercept, h = np.zeros(d), theta[-2], -theta[-1]
        slopes[used] = theta[:-2]

        def terms(x, t):
            u = h * t - x @ slopes - intercept
            ratio, log_cdf = _mills(u)
            free = t > floor
            return np.where(free, 1.0, ratio * (u + ratio)), np.where(free, u, -ratio), float(np.where(free, 0.5 * u * u - math.log(h), -log_cdf).sum())
        return moments(rows, features, "__y", terms)

    passes, step, last, history = 1, None, None, []
    while passes < most:
        information, gradient, loss = evaluate(theta)
        passes += 1
        if last is not None and loss > last[1] + 1e-12 * abs(last[1]):
            step = 0.5 * step
            theta = last[0] + step
            continue
        h = -theta[-1]
        g, matrix = gradient[at], information[np.ix_(at, at)]
        g[-1] -= free / h
        matrix[-1, -1] += free / h ** 2
        size = float(np.abs(g / units).max() / n)
        history.append((passes, 1.0 / h, loss / n, size))
        if size < tolerance:
            # delta method: coefficients are theta / h, sigma is 1 / h
            turn = np.eye(len(theta)) / h
            turn[:, -1] = theta / h ** 2
            turn[-1, -1] = 1.0 / h ** 2
            errors, slopes = np.full(d + 2, np.nan), np.zeros(d)
            errors[at] = np.sqrt(np.diag(turn @ np.linalg.pinv(matrix) @ turn.T))
            slopes[used] = theta[:-2] / h
            return LinearFit(slopes, float(theta[-2] / h), 1.0 / h, errors, size, passes, history)
        step = np.linalg.lstsq(matrix, g, rcond=None)[0]
        while theta[-1] + step[-1] >= 0:  # sigma stays positive
            step = 0.5 * step
        last, theta = (theta, loss), theta + step
    raise RuntimeError(f"the censored fit did not converge in {most} passes")
