"""Toxicity by a classifier chain.

The categories are predicted in order.  Each has a logistic regression on the
document's terms; it also gets the probabilities of the categories before it.
Those it is trained with are out-of-fold: each row's come from a model that has
not seen the row, and neither have its terms and their values.  The labels at
hand are quality and toxicity, so those are the chain's categories by default;
any others may be named.

Terms are words and their beginnings, lower-cased; a document has a term or
not, so text length doesn't dilute it.  The terms that tell a category's rows
apart (chi-square over the sample) are kept; a term's value is the size of its
log-odds there, so few rows suffice to trust rare telling words.  The classifier is fitted on a
bounded sample of labelled rows: at most ``SAMPLE_PER_CLASS`` rows for each
value of each category, the first in the order of a hash of their ids.
Everything else covers all rows.

Null and empty texts have no terms and get the chain's answer for that; labels
that are null are left out, and where an id has several labels the largest
counts.  Rows of one id are in one fold.  Without any labelled row, or with one
class only, a category's probability is the share of positives (0 without
labels).  Repeated rows are scored each; extra columns stay, but one that has
the name of a score is replaced by it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import bound_batches

SAMPLE_PER_CLASS = 1500
TERMS_PER_CATEGORY = 200
FOLDS = 3
CATEGORIES = ("quality", "toxic")
BEGINNINGS = (3, 4, 5, 6)
#: Words whose terms a worker remembers before it starts over.
WORDS_HELD = 100_000
_WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in BEGINNINGS if len(word) >= k)]


def document_terms(text: str | None) -> set[str]:
    return {t for w in set(_WORD.findall((text or "").lower())) for t in word_terms(w)}


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 300) -> Logistic:
    """Ridge-penalised logistic regression by accelerated gradient steps."""
    share = y.mean() if len(y) else 0.0
    if share in (0.0, 1.0):
        return Logistic(np.zeros(x.shape[1]), 30.0 if share else -30.0)
    weight = np.full(len(y), 1 / len(y))
    full = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    bound = 0.25 * float(((full**2).sum(1) * weight).sum()) + l2
    w, v, step = np.zeros(full.shape[1]), np.zeros(full.shape[1]), 1 / bound
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ v, -30, 30)))
        grad = full.T @ (weight * (p - y)) + l2 * np.append(v[:-1], 0)
        new = v - step * grad
        v = new + k / (k + 3) * (new - w)
        w = new
    return Logistic(w[:-1], float(w[-1]))


@dataclass
class ToxicityChain:
    categories: tuple[str, ...]
    terms: dict[str, int]
    models: list[Logistic] = field(default_factory=list)
    #: the value of each term, by place
    scales: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(rows, categories): each model sees the probabilities before its own."""
        for model in self.models:
            x = np.hstack([x, model.predict(x)[:, None]])
        return x[:, x.shape[1] - len(self.models) :]


def fit_models(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, apart: dict[int, np.ndarray] | None = None) -> list[Logistic]:
    """A model per column of ``labels`` (NaN: unknown); later ones are trained with the
    out-of-fold probabilities of those before.  ``apart``: for each fold the terms' values as
    chosen without it."""
    models, folds = [], sorted(set(fold.tolist()))
    apart = dict(apart) if apart else {f: x for f in folds}
    for k in range(labels.shape[1]):
        known = ~np.isnan(labels[:, k])
        ahead = np.zeros(len(x))
        for f in folds:
            train = known & (fold != f)
            ahead[fold == f] = fit_logistic(apart[f][train], labels[train, k]).predict(apart[f][fold == f])
        models.append(fit_logistic(x[known], labels[known, k]))
        x = np.hstack([x, ahead[:, None]])
        apart = {f: np.hstack([v, ahead[:, None]]) for f, v in apart.items()}
    return models


def _count_terms(categories: tuple[str, ...]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for frame in frames:
            for text, fold, *labels in frame[["text", "fold", *categories]].itertuples(index=False):
                mark = (fold, *(-1 if pd.isna(v) else int(v) for v in labels))
                counts.update((t, mark) for t in document_terms(text))
        parts = [(t, *mark, n) for (t, mark), n in counts.items()]
        yield pd.DataFrame(parts, columns=["term", "fold", *categories, "n"])

    return run


def _telling(counts: DataFrame, totals: dict[tuple, int], categories: tuple[str, ...], without: int | None, n_terms: int) -> dict[str, float]:
    """The chosen terms and their values, from all folds but one."""
    kept = F.lit(True) if without is None else F.col("fold") != without
    parts = {(c, v): F.sum(F.when(kept & (F.col(c) == v), F.col("n")).otherwise(0)).alias(f"{c}_{v}") for c in categories for v in (0, 1)}
    summed = counts.groupBy("term").agg(*parts.values())
    picked: dict[str, float] = {}
    for c in categories:
        with_0, with_1 = (max(sum(n for (k, value, fold), n in totals.items() if k == c and value == v and fold != without), 1) for v in (0, 1))
        gap = F.col(f"{c}_1") / with_1 - F.col(f"{c}_0") / with_0
        all_with = F.col(f"{c}_1") + F.col(f"{c}_0")
        score = gap * gap / ((all_with + 1) * (with_1 + with_0 + 1 - all_with))
        odds = F.abs(F.log((F.col(f"{c}_1") + 0.5) / (with_1 + 1)) - F.log((F.col(f"{c}_0") + 0.5) / (with_0 + 1)))
        top = summed.where(all_with >= 3).orderBy(score.desc(), "term").limit(n_terms).select("term", odds.alias("odds")).collect()
        picked |= {r.term: max(r.odds, picked.get(r.term, 0.0)) for r in top}
    return picked


def _sample_terms(terms: dict[str, int], categories: tuple[str, ...]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[["doc_id", *categories, "fold"]].copy()
            out["terms"] = [sorted(terms[t] for t in document_terms(x) if t in terms) for x in frame["text"]]
            yield out

    return run


def fit_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, per_class: int = SAMPLE_PER_CLASS, n_terms: int = TERMS_PER_CATEGORY) -> ToxicityChain:
    """Fit on ``labels`` (doc_id and a 0/1 column per category) and the texts of ``docs``."""
    labels = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.col(c).cast("int")).alias(c) for c in categories))
    order = F.xxhash64("doc_id")
    chosen = None
    for c in categories:
        for value in (0, 1):
            part = labels.where(F.col(c) == value).orderBy(order, "doc_id").limit(per_class)
            chosen = part if chosen is None else chosen.union(part)
    ids = chosen.distinct().toPandas()  # at most 2 * categories * per_class rows
    spark = docs.sparkSession
    schema = "doc_id long, " + ", ".join(f"{c} int" for c in categories)
    rows = [[None if pd.isna(v) else int(v) for v in r] for r in ids.itertuples(index=False)]
    sample = spark.createDataFrame(rows, schema)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").withColumn("fold", fold).cache()
    try:
        ints = ", ".join(f"{c} int" for c in categories)
        counts = texts.mapInPandas(_count_terms(categories), f"term string, fold int, {ints}, n long")
        # partial sums by term, fold and labels; a term has at most folds * 3 ** categories of them
        counts = counts.groupBy("term", "fold", *categories).agg(F.sum("n").alias("n")).cache()
        rows_of = texts.groupBy("fold").agg(*(F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c in categories for v in (0, 1))).collect()
        totals = {(c, v, r["fold"]): r[f"{c}_{v}"] for r in rows_of for c in categories for v in (0, 1)}
        picked = {f: _telling(counts, totals, categories, f, n_terms) for f in (None, *range(FOLDS))}
        counts.unpersist()
        places = {t: i for i, t in enumerate(sorted(set().union(*picked.values())))}
        data = texts.mapInPandas(_sample_terms(places, categories), f"{schema}, fold int, terms array<int>").toPandas()
    finally:
        texts.unpersist()
    data = data.sort_values("doc_id", key=lambda s: pd.util.hash_array(s.to_numpy(np.int64))).reset_index(drop=True)

    def valued(chosen: dict[str, float]) -> np.ndarray:
        """(rows, chosen terms in order) with each term's value where the row has it."""
        column = np.full(len(places), -1)
        for i, t in enumerate(sorted(chosen)):
            column[places[t]] = i
        values = np.array([chosen[t] for t in sorted(chosen)], np.float32)
        x = np.zeros((len(data), len(chosen)), np.float32)
        for i, have in enumerate(data["terms"]):
            at = column[np.asarray(have, int)]
            at = at[at >= 0]
            x[i, at] = values[at]
        return x

    final = picked[None]
    models = fit_models(valued(final), data[list(categories)].to_numpy(float), data["fold"].to_numpy(), {f: valued(picked[f]) for f in range(FOLDS)})
    return ToxicityChain(categories, {t: i for i, t in enumerate(sorted(final))}, models, np.array([final[t] for t in sorted(final)]))


def score_documents(docs: DataFrame, chain: ToxicityChain, text: str = "text", prefix: str = "p_") -> DataFrame:
    """All columns of ``docs`` and a probability for each category."""
    bound_batches(docs.sparkSession)
    n = len(chain.terms)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, ...]] = {}
        for part in parts:
            found: list[set[int]] = []
            for value in part:
                have: set[int] = set()
                for word in set(_WORD.findall(value.lower())) if value else ():
                    hit = known.get(word)
                    if hit is None:
                        if len(known) >= WORDS_HELD:
                            known.clear()
                        hit = known[word] = tuple(chain.terms[t] for t in word_terms(word) if t in chain.terms)
                    if hit:
                        have.update(hit)
                found.append(have)
            scores = np.zeros((len(found), len(chain.categories)))
            for at in range(0, len(found), 1000):
                x = np.zeros((len(found[at : at + 1000]), n))
                for i, have in enumerate(found[at : at + 1000]):
                    at_terms = list(have)
                    x[i, at_terms] = chain.scales[at_terms]
                scores[at : at + 1000] = chain.predict(x)
            yield pd.DataFrame(scores, columns=list(chain.categories))

    kind = ", ".join(f"`{c}` double" for c in chain.categories)
    made, held = [f"{prefix}{c}" for c in chain.categories], "chain"
    while held in {c.lower() for c in docs.columns}:
        held = "_" + held
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {m.lower() for m in made}]
    scored = docs.withColumn(held, F.pandas_udf(run, kind)(F.col(f"`{text}`")))
    return scored.select(*kept, *(F.col(held)[c].alias(m) for c, m in zip(chain.categories, made)))
