"""Mixing documents to target weights of domains known only softly.

A classifier learned from the labelled table gives each document a posterior
over domains. Rates then minimise the squared distance between the expected
tokens of each domain and its target, by gradient steps projected onto the
range that rates may have, each as long as the documents whose rates are within
it can take. A step needs sums by domains over all documents and sends back one
number a domain, so a document's rate is folded from its own
posterior and the steps so far, and nothing per document leaves its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafline.llm.linear import Linear, fit
from leafline.llm.runtime import Sent, Tables, fresh, plus

#: Domains of the labelled table, and the share of tokens that each should have.
DOMAINS = ("clean", "toxic", "low")
WEIGHTS = {"clean": 0.94, "toxic": 0.01, "low": 0.05}


def domain_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labelled rows with ``y``, one number for each of DOMAINS; rows without a quality are left out."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    domain = F.when(toxic, 1).when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 2)
    marks = F.array(*[(domain == k).cast("int") for k in range(len(DOMAINS))])
    return labels.where(domain.isNotNull()).select(id_col, marks.alias("y"))


def with_posteriors(docs: DataFrame, model: Linear, text_col: str = "text", tokens: str = "n_tokens", posterior: str = "posterior") -> DataFrame:
    """``docs`` with columns ``tokens`` (white-space words) and ``posterior``, an array over domains; such columns of ``docs`` are replaced."""
    docs = docs.drop(tokens, posterior)
    held = Sent(docs.sparkSession, model)
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins, counts = held.value.margins(batch.column(text_at))
            p = 1 / (1 + np.exp(-np.clip(margins, -35, 35)))
            p /= p.sum(1, keepdims=True)
            lists = pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), p.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), lists], [*batch.schema.names, tokens, posterior])

    return docs.mapInArrow(run, plus(docs.schema, **{tokens: T.LongType(), posterior: T.ArrayType(T.DoubleType())}))


def rate(posterior: Column, steps: list[list[float]], cap: float, begin: Column | None = None) -> Column:
    """The rate of a document after ``steps``, each a number a domain, from one (or ``cap``, if less) or ``begin`` on."""
    begin = F.lit(min(1.0, float(cap))) if begin is None else begin
    if not steps:
        return begin
    taken = F.array(*[F.array(*[F.lit(float(y)) for y in step]) for step in steps])

    def move(r: Column, step: Column) -> Column:
        pull = sum((posterior[k] * step[k] for k in range(len(steps[0]))), F.lit(0.0))
        return F.least(F.greatest(r - pull, F.lit(0.0)), F.lit(float(cap)))

    return F.aggregate(taken, begin, move)


def fit_rates(scored: DataFrame, weights: list[float], cap: float, total: float | None = None, close: float = 5e-4, kept_steps: int = 8) -> list[list[float]]:
    """Steps of projected-gradient least squares over ``n_tokens, posterior`` of ``scored``.

    Targets are ``weights`` times ``total`` tokens; by default as many as the
    first domain can fill at rate one, or all there are if its weight is zero.
    A step goes along the gradient, scaled by the second moments of documents
    whose rate can follow it (no bound is in the way, by the gradient before), to
    where these alone would meet the targets. If that leads farther off, a
    quarter of it is tried, then the gradient scaled by the moments of all
    documents, at a length that grows while it helps, and at last at the length
    that always leads nearer. Ends when each target is met within ``close`` of it
    (of a thousandth of the total, if it is less), or when no step takes a
    ten-thousandth off the squared distance, or five together less than a
    fiftieth: then the bounds keep the targets out of reach. Every ``kept_steps`` steps the rates so far are written beside the
    posteriors, so no step folds more than that many.
    """
    k = len(weights)
    p = [F.col(f"p{i}") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(k)]
    tables = Tables(scored.sparkSession)
    given = scored.select(F.col("n_tokens").cast("double").alias("t"), *[F.col("posterior")[i].alias(f"p{i}") for i in range(k)])
    moments = given.agg(*[F.sum(F.col("t") * p[i] * p[j]) for i, j in pairs], *[F.sum(F.col("t") * p[i]) for i in range(k)]).first()
    moments = np.array([x or 0.0 for x in moments])
    second, have = moments[: k * k].reshape(k, k), moments[k * k :]
    if have.sum() <= 0:
        return []
    if total is None:
        total = have[0] / weights[0] if weights[0] > 0 else have.sum()
    target = np.array(weights) * total
    near = close * np.maximum(target, 1e-3 * total)

    def scaled(matrix: np.ndarray, firm: float) -> np.ndarray:
        return np.linalg.inv(matrix + np.eye(k) * firm * max(matrix.trace(), 1e-9 * second.trace(), 1e-18))

    whole = scaled(second, 1e-4)  # firm enough that a domain which hardly any document has does not outweigh the others
    steps: list[list[float]] = []
    trials: list[np.ndarray] = []  # steps from the best rates so far that are still to be tried
    held, since = tables.put(given.withColumn("r", F.lit(min(1.0, float(cap))))), 0
    best, size, losses = None, 1.0, []
    pull = whole @ (have * min(1.0, float(cap)) - target)
    while True:
        rated = held.select("t", *p, rate(F.array(*p), steps[since:], cap, F.col("r")).alias("r"))
        down = sum((p[i] * float(pull[i]) for i in range(k)), F.lit(0.0))
        follows = ((F.col("r") > 0) | (down < 0)) & ((F.col("r") < float(cap)) | (down > 0))
        free = F.when(follows, F.col("t")).otherwise(0.0)
        sums = rated.agg(*[F.sum(F.col("t") * F.col("r") * p[i]) for i in range(k)], *[F.sum(free * p[i] * p[j]) for i, j in pairs]).first()
        sums = np.array([x or 0.0 for x in sums])
        off = sums[:k] - target
        loss = float(off @ whole @ off)
        if (np.abs(off) <= near).all():
            break
        if best is None or loss < best * (1 - 1e-4):
            losses.append(loss)
            if len(losses) > 5 and loss > 0.98 * losses[-6]:
                break
            size = 4 * size if len(trials) == 1 else 1.0
            best, pull = loss, whole @ off
            if len(steps) - since >= kept_steps:
                held, before = tables.put(rated), held
                tables.drop(before)
                since = len(steps)
            along = scaled(sums[k:].reshape(k, k), 1e-7) @ off
            trials = [along, along / 4, pull * size, pull]
        else:
            steps.pop()
            if not trials:
                break
        steps.append(trials.pop(0).tolist())
    tables.drop(held)
    return steps


def mix_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, cap: float = 4.0, id_col: str = "doc_id", text_col: str = "text", total: float | None = None, sample_rows: int = 10_000) -> DataFrame:
    """The rate of every document.

    Returns ``doc_id, n_tokens, p_clean, p_toxic, p_low, rate``: over all
    documents the sums of ``rate * n_tokens * p`` are the targets, or as near
    them as rates from 0 to ``cap`` allow. Null and empty texts have no tokens, the
    intercept's posterior and a rate like others of that posterior. Where no
    label was learned all posteriors are alike and all rates one, or ``cap`` if
    that is less. Null ids and repeated rows get their rate
    like any other; extra columns are ignored; an empty table gives an empty
    result.
    """
    model = fit(docs, domain_labels(labels, id_col), id_col, text_col, len(DOMAINS), sample_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = Tables(docs.sparkSession).put(with_posteriors(rows, model).drop("text"))
    steps = fit_rates(scored, [weights[x] for x in DOMAINS], cap, total) if model.weights.any() else []
    named = [F.col("posterior")[k].alias(f"p_{x}") for k, x in enumerate(DOMAINS)]
    return scored.select("doc_id", "n_tokens", *named, rate(F.col("posterior"), steps, cap).alias("rate"))


def sample_mixture(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 10_000) -> DataFrame:
    """``docs`` thinned to the mixture: a row stays if a hash of its id and text falls below its rate.

    Rates are at most one, and targets are as many tokens as the first domain
    has, so documents of that domain stay. Where no label was learned all stay.
    A null id counts as any other in the hash; rows alike in id and text stay or
    go together. Null and empty texts have a rate like others of their
    posterior. An empty table gives an empty result; all columns, whatever
    their names, are as they were.
    """
    model = fit(docs, domain_labels(labels, id_col), id_col, text_col, len(DOMAINS), sample_rows)
    if not model.weights.any():
        return docs
    tokens, posterior = fresh(docs.columns, "n_tokens"), fresh(docs.columns, "posterior")
    # texts are scored once; the pass over them that the rates need reads what was written
    scored = Tables(docs.sparkSession).put(with_posteriors(docs, model, text_col, tokens, posterior))
    steps = fit_rates(scored.select(F.col(tokens).alias("n_tokens"), F.col(posterior).alias("posterior")), [weights[x] for x in DOMAINS], 1.0)
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(10)), F.lit(1 << 30)) / float(1 << 30)
    return scored.where(draw < rate(F.col(posterior), steps, 1.0)).select(*docs.columns)
