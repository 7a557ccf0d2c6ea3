"""Metric learning on profile pairs: a diagonal metric and a small projection network.

Training triples are made by joins; one full-batch step is a pass of
``mapInArrow`` over the triples that returns a partial gradient per
partition, which the driver adds.  So the triples stay on the cluster, and the
driver holds only the parameters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.operators import retrieval
from spanmill.sources.scratch import written


#: Places of a scope whose queries are put together.
NEAR = 4096


def training_triples(queries: DataFrame, candidates: DataFrame, entity: str, scope: str, negatives: int = 32, seed: int = 0) -> DataFrame:
    """(entity, anchor, positive, negatives array<array<double>>): each query with its own row
    and up to ``negatives`` others of its scope; fewer are repeated in turn, and a query
    without others is left out.  Inputs have the entity (once each), the scope and a vector v.

    The candidates of a scope are numbered from 0 in the order of a seeded hash, as a ring.
    A query takes the places that follow a hashed start, all different, so the join meets
    rows of one place and the pairs of a scope are never made."""
    own = queries.select(entity, scope, F.col("v").alias("anchor")).join(candidates.select(entity, F.col("v").alias("positive")), entity)
    ring = _places(candidates.select(F.col(entity).alias("_other"), scope, F.col("v").alias("_v")), "_other", scope, seed)
    sizes = ring.groupBy(scope).agg(F.count("*").alias("_size"))
    start = F.xxhash64(F.lit(seed), F.lit("start"), F.col(entity))
    # one place more, in case the query's own row is among them
    steps = F.sequence(F.lit(0).cast("long"), F.least(F.col("_size"), F.lit(negatives + 1).cast("long")) - 1)
    wanted = own.select(entity, scope).join(sizes, scope).select(entity, scope, "_size", F.explode(steps).alias("_n"))
    wanted = wanted.withColumn("_place", F.pmod(F.pmod(start, F.col("_size")) + F.col("_n"), F.col("_size")))
    wanted = wanted.withColumn("_first", F.pmod(start, F.col("_size")))
    met = wanted.join(ring, [scope, "_place"]).where(F.col(entity) != F.col("_other"))
    held = met.groupBy(entity).agg(F.slice(F.array_sort(F.collect_list(F.struct("_n", "_v"))), 1, negatives).alias("_held"), F.first("_first").alias("_first"))
    cycled = F.transform(F.sequence(F.lit(0), F.lit(negatives - 1)), lambda i: F.get(F.col("_held"), (i % F.size("_held")).cast("int"))["_v"])
    # queries that start at near places share most of their others, which ``packed`` then keeps once
    near = own.join(held, entity).repartition(scope, F.floor(F.col("_first") / NEAR)).sortWithinPartitions(scope, "_first", entity)
    return near.select(entity, "anchor", "positive", cycled.alias("negatives"))


def _places(rows: DataFrame, key: str, scope: str, seed: int, parts: int = 256) -> DataFrame:
    """Rows with ``_place``, their number within the scope in the order of a hash of the key.  A
    scope is numbered in ``parts`` ranges of that hash, so a large one is spread over tasks."""
    width = 2**64 // parts
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("_part", F.floor(F.col("_h") / F.lit(width)))
    counts = hashed.groupBy(scope, "_part").agg(F.count("*").alias("_rows"))  # at most ``parts`` rows a scope
    before = Window.partitionBy(scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(scope, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(scope, "_part").orderBy("_h", key))
    return hashed.withColumn("_within", within).join(shifts, [scope, "_part"]).withColumn("_place", F.col("_before") + F.col("_within") - 1).drop("_h", "_part", "_within", "_before")


#: Triples that are kept together as bytes, and different others up to which a pack is compared as a whole.
PACKED, COMPARED = 64, 512


def packed(triples: DataFrame) -> DataFrame:
    """(n, d, anchors, others, places): runs of triples as the bytes of their arrays, which a pass over them
    hands to numpy without taking lists apart.  A vector that several triples have among their others is kept once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACKED):
                a, b = _arrays(batch.slice(at, PACKED))
                flat = np.ascontiguousarray(b.astype("<f8").reshape(-1, b.shape[2]))
                _, first, place = np.unique(flat.view(f"V{flat.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
                yield pa.RecordBatch.from_pydict({"n": [len(a)], "d": [a.shape[2]], "anchors": [a.astype("<f8").tobytes()], "others": [flat[first].tobytes()], "places": [place.astype("<i4").tobytes()]})

    return triples.mapInArrow(run, "n long, d long, anchors binary, others binary, places binary")


def _shared(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors (n, d), the different others (m, d) and which of them a triple has (n, 1 + k)."""
    n, d = row["n"], row["d"]
    return np.frombuffer(row["anchors"], "<f8").reshape(n, d), np.frombuffer(row["others"], "<f8").reshape(-1, d), np.frombuffer(row["places"], "<i4").reshape(n, -1)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Anchors (n, 1, d) and the others (n, 1 + k, d) of a packed row."""
    anchors, others, places = _shared(row)
    return anchors[:, None], others[places]


def _arrays(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Anchors (n, 1, d) and the others (n, 1 + k, d), the positive first."""
    n = batch.num_rows
    flat = lambda column: column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)
    a, p = (flat(pc.list_flatten(batch[name])).reshape(n, 1, -1) for name in ("anchor", "positive"))
    others = flat(pc.list_flatten(pc.list_flatten(batch["negatives"]))).reshape(n, -1, a.shape[2])
    return a, np.concatenate([p, others], axis=1)


def _softmax_loss(score: np.ndarray, temperature: float) -> tuple[float, np.ndarray]:
    """Summed loss of the first column against all, and its gradient by the scores."""
    z = score / temperature
    z = z - z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    loss = -np.log(np.maximum(p[:, 0], 1e-12)).sum()
    p[:, 0] -= 1
    return float(loss), p / temperature


def diagonal_scores(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    top = (a * b) @ w
    return top / np.sqrt(np.maximum((a * a @ w) * (b * b @ w), 1e-12))


def diagonal_loss(a: np.ndarray, b: np.ndarray, w: np.ndarray, temperature: float) -> tuple[float, np.ndarray]:
    """Loss and gradient by the weights."""
    loss, grad = arms_loss(a, b, w[:, None], temperature)
    return float(loss[0]), grad[:, 0]


def arms_loss(a: np.ndarray, b: np.ndarray, w: np.ndarray, temperature: float) -> tuple[np.ndarray, np.ndarray]:
    """Losses (arms) and gradients (size, arms) of the weights ``w`` (size, arms) of several arms:
    products are made once and meet all arms as matrices.  With s the score, d s / d w_i is
    a_i b_i / sqrt(AB) - s/2 (a_i^2 / A + b_i^2 / B)."""
    n, k, d = b.shape
    direct, own, other = (a * b).reshape(n * k, d), (a * a).reshape(n, d), (b * b).reshape(n * k, d)
    size_a, size_b = np.maximum(own @ w, 1e-12)[:, None], np.maximum(other @ w, 1e-12).reshape(n, k, -1)
    root = np.sqrt(np.maximum(size_a * size_b, 1e-12))
    s = (direct @ w).reshape(n, k, -1) / root
    z = s / temperature
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    loss = -np.log(np.maximum(p[:, 0], 1e-12)).sum(0)
    p[:, 0] -= 1
    g = p / temperature
    by_b = (g * s / (2 * size_b)).reshape(n * k, -1)
    return loss, direct.T @ (g / root).reshape(n * k, -1) - own.T @ (g * s / (2 * size_a)).sum(1) - other.T @ by_b


def shared_loss(a: np.ndarray, u: np.ndarray, places: np.ndarray, w: np.ndarray, temperature: float) -> tuple[np.ndarray, np.ndarray]:
    """``arms_loss`` of anchors and the others that ``places`` names among ``u``: all anchors meet all of ``u`` in a
    matrix product, and squares are made once a vector, not once a triple.  Few shared vectors go the plain way."""
    (n, m), arms = (len(a), len(u)), w.shape[1]
    if m > COMPARED:
        return arms_loss(a[:, None], u[places], w, temperature)
    own, other = a * a, u * u
    size_a, size_b = np.maximum(own @ w, 1e-12)[:, None], np.maximum(other @ w, 1e-12)[places]
    root = np.sqrt(np.maximum(size_a * size_b, 1e-12))
    rows = np.arange(n)[:, None]
    s = np.stack([((a * w[:, k]) @ u.T)[rows, places] for k in range(arms)], axis=2) / root
    z = s / temperature
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    loss = -np.log(np.maximum(p[:, 0], 1e-12)).sum(0)
    p[:, 0] -= 1
    g = p / temperature
    direct, by_a, by_b = g / root, (g * s / (2 * size_a)).sum(1), g * s / (2 * size_b)
    cells, each = (rows * m + places).ravel(), places.ravel()
    grad = -(own.T @ by_a)
    for k in range(arms):
        met = np.bincount(cells, direct[:, :, k].ravel(), n * m).reshape(n, m)
        grad[:, k] += ((met @ u) * a).sum(0) - other.T @ np.bincount(each, by_b[:, :, k].ravel(), m)
    return loss, grad


def _partial(kernel, taken):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad, n = 0.0, 0.0, 0
        for batch in batches:
            for row in batch.to_pylist():
                more, g = kernel(*taken(row))
                loss, grad, n = loss + more, grad + g, n + row["n"]
        if n:
            yield pa.RecordBatch.from_pydict({"loss": [np.atleast_1d(loss).tolist()], "grad": [grad.ravel().tolist()], "n": [n]})

    return run


def _step(triples: DataFrame, kernel, taken=_unpacked) -> tuple[np.ndarray, np.ndarray]:
    """Mean losses and flat gradient over all triples: a row a partition comes to the driver."""
    parts = triples.mapInArrow(_partial(kernel, taken), "loss array<double>, grad array<double>, n long").collect()
    n = sum(p.n for p in parts)
    if not n:
        raise ValueError("no training triples")
    return np.sum([p.loss for p in parts], axis=0) / n, np.sum([p.grad for p in parts], axis=0) / n


@dataclass
class DiagonalFit:
    weights: np.ndarray
    history: list[float]


def train_arms(triples: DataFrame, size: int, strengths: Sequence[float], iterations: int = 300, rate: float = 0.5, temperature: float = 0.1, tolerance: float = 0.0) -> dict[float, DiagonalFit]:
    """For each strength of the pull to 1, non-negative weights of mean 1 by projected steps.  The
    pull is taken implicitly, so it is stable for any strength.

    A step is one job for all arms, whose gradients a pass over the triples gives together
    as a matrix.  Training ends after ``iterations`` steps, or when no arm's objective moves by
    more than ``tolerance``."""
    triples = written(packed(triples))
    pulls = np.array([2 * rate * s / size for s in strengths])
    w = np.ones((size, len(strengths)))
    history: list[np.ndarray] = []
    for _ in range(iterations):
        loss, grad = _step(triples, lambda a, u, places, w=w: shared_loss(a, u, places, w, temperature), _shared)
        history.append(loss + np.array(strengths) * np.mean((w - 1) ** 2, axis=0))
        w = np.maximum((w - rate * grad.reshape(w.shape) + pulls) / (1 + pulls), 0.0)
        if (w.sum(0) <= 0).any():
            raise ValueError("all weights are zero")
        w = w * (size / w.sum(0))
        if tolerance and len(history) > 1 and np.abs(history[-1] - history[-2]).max() <= tolerance:
            break
    return {s: DiagonalFit(w[:, i].copy(), [float(h[i]) for h in history]) for i, s in enumerate(strengths)}


def train_diagonal(triples: DataFrame, size: int, regularization: float, iterations: int = 300, rate: float = 0.5, temperature: float = 0.1) -> DiagonalFit:
    """One arm of ``train_arms``."""
    return train_arms(triples, size, [regularization], iterations, rate, temperature)[regularization]


def arm_ranks(queries: DataFrame, candidates: DataFrame, fits: dict[float, DiagonalFit], entity: str, scope: str, digits: int = 9) -> DataFrame:
    """(regularization, entity, rank, pool_size): self-ranks within the scope under every arm's
    weights, in one job: an arm is a part of the scope."""
    roots = F.array(*(F.struct(F.lit(float(s)).alias("regularization"), F.array(*(F.lit(float(x) ** 0.5) for x in f.weights)).alias("_w")) for s, f in fits.items()))

    def scaled(rows: DataFrame) -> DataFrame:
        every = rows.select(entity, scope, "v", F.explode(roots).alias("_a")).select(entity, scope, "v", "_a.*")
        named = F.concat_ws("|", F.col("regularization").cast("string"), F.col(scope).cast("string"))
        return every.select("regularization", entity, named.alias("_scope_arm"), F.zip_with("v", "_w", lambda x, y: x * y).alias("v"))

    return retrieval.vector_ranks(scaled(queries), scaled(candidates), ["regularization", entity], scope="_scope_arm", digits=digits)


def weight_stability(weights: DataFrame, collapse: float = 0.05, unstable: float = 0.5) -> DataFrame:
    """``weights`` (feature, arm, weight) -> how far each feature's weight moves across arms."""
    low, high = F.min("weight"), F.max("weight")
    return weights.groupBy("feature").agg(
        low.alias("min_weight"), high.alias("max_weight"), (high - low).alias("spread"),
        F.bool_or(F.col("weight") < collapse).alias("collapsed_in_any"), F.bool_and(F.col("weight") < collapse).alias("collapsed_in_every"),
        (high - low > unstable).alias("unstable"),
    )


# a projection network of one hidden layer


def init_network(size: int, hidden: int, out: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {"w1": rng.normal(0, np.sqrt(2 / size), (size, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, np.sqrt(2 / hidden), (hidden, out)), "b2": np.zeros(out)}


def project(x: np.ndarray, net: dict[str, np.ndarray]) -> np.ndarray:
    return np.maximum(x @ net["w1"] + net["b1"], 0) @ net["w2"] + net["b2"]


def network_loss(a: np.ndarray, b: np.ndarray, net: dict[str, np.ndarray], temperature: float) -> tuple[float, np.ndarray]:
    """Loss of cosine scores of projections, and its gradient as one flat vector."""
    pa, pb = project(a, net), project(b, net)
    na, nb = (np.sqrt(np.maximum((p * p).sum(-1, keepdims=True), 1e-12)) for p in (pa, pb))
    ua, ub = pa / na, pb / nb
    s = (ua * ub).sum(-1)
    loss, g = _softmax_loss(s, temperature)
    g = g[..., None]
    da = (g * (ub - s[..., None] * ua) / na).sum(1, keepdims=True)
    db = g * (ua - s[..., None] * ub) / nb
    grads = {k: np.zeros_like(v) for k, v in net.items()}
    for x, d in ((a, da), (b, db)):
        x, d = x.reshape(-1, x.shape[-1]), d.reshape(-1, d.shape[-1])
        h = np.maximum(x @ net["w1"] + net["b1"], 0)
        grads["w2"] += h.T @ d
        grads["b2"] += d.sum(0)
        back = (d @ net["w2"].T) * (h > 0)
        grads["w1"] += x.T @ back
        grads["b1"] += back.sum(0)
    return loss, np.concatenate([grads[k].ravel() for k in net])


def train_network(triples: DataFrame, size: int, hidden: int, out: int, evaluate, seed: int = 0, epochs: int = 50, rate: float = 0.05, momentum: float = 0.9, patience: int = 5, temperature: float = 0.1) -> tuple[dict, float]:
    """Full-batch momentum steps; keeps the parameters with the best ``evaluate(net)`` and stops
    after ``patience`` epochs without a better one."""
    triples = written(packed(triples))
    net = init_network(size, hidden, out, seed)
    speed = np.zeros(sum(v.size for v in net.values()))
    best, best_net, waited = -np.inf, net, 0
    for _ in range(epochs):
        _, grad = _step(triples, lambda a, b, net=net: network_loss(a, b, net, temperature))
        speed = momentum * speed - rate * grad
        at, moved = 0, {}
        for k, v in net.items():
            moved[k] = v + speed[at : at + v.size].reshape(v.shape)
            at += v.size
        net = moved
        value = evaluate(net)
        if value > best:
            best, best_net, waited = value, net, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return best_net, best


def embed(vectors: DataFrame, net: dict[str, np.ndarray], column: str = "v") -> DataFrame:
    """The vector column projected, in Arrow batches."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(project(np.array(part.to_list(), float), net))) if len(part) else part

    return vectors.withColumn(column, F.pandas_udf(run, "array<double>")(F.col(column)))


def calibration(scores: DataFrame, bins: int = 5) -> DataFrame:
    """``scores`` (score, correct) in bins of equal count by exact quantiles, each (low, high]:
    (bin, n, mean_score, accuracy)."""
    edges = scores.agg(F.percentile("score", F.array(*(F.lit(i / bins) for i in range(bins + 1)))).alias("_e"))
    placed = scores.crossJoin(F.broadcast(edges))  # one row
    bin_of: Column = F.least(F.greatest(F.size(F.filter("_e", lambda e: e < F.col("score"))), F.lit(1)), F.lit(bins))
    return placed.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
