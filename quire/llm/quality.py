"""Quality classification by positive-unlabelled learning.

A linear model over text statistics and their squares minimises the non-negative unbiased risk with sigmoid
loss: pi R_p(+) + max(0, R_u(-) - pi R_p(-)), from trusted positives and unlabelled web text. The class
prior pi is estimated first: a plain classifier of positives against unlabelled text ranks both, and the
smallest upper bound on the ratio of the shares that pass a threshold is the prior. Known negatives aren't
used.

Statistics are computed once for every whole text and written. Their means and deviations, and the shares of
unlabelled texts that pass the thresholds, are counted over all training rows; only gradients use samples, at most ``MAX_POSITIVES``
and (in expectation) ``MAX_UNLABELLED`` rows picked by a hash of doc_id.

Defined results: null and empty texts are scored from statistics that are all zero; labels that are null or
lack a document are ignored, repeated ones count as trusted only if all are 1; without positives every score
is 0.5; with 20 or fewer positives or unlabelled rows no share can be estimated and the prior is ``NO_PRIOR``; rows that repeat a
doc_id each get a score; empty tables give empty results; extra columns are ignored; reruns agree.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.toxicity import fit_logistic, remainder
from quire.runtime import materialize, ship_code, spread

MAX_POSITIVES, MAX_UNLABELLED, THRESHOLD, NO_PRIOR = 10_000, 20_000, 0.7, 0.5
LETTERS = re.compile(r"[^\W\d_]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
SYMBOLS = re.compile(r"[#$%&*|~^=+<>{}\[\]\\/@_]")
ENDS = re.compile(r"(?<=\S)[.,;:!?](?=\s|\Z)")
LOUD = re.compile(r"!")
DIGITS = re.compile(r"\d")
N_FEATURES = 18


def statistics(text: str | None) -> list[float]:
    """Length, variety, repetition, casing, symbols, punctuation and compressibility of a text."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    size, counts = len(text), Counter(words)
    lengths = [len(w) for w in words]
    lines = [line for line in text.split("\n") if line.strip()]
    raw = text.encode("utf-8", "surrogatepass")
    letters = len(LETTERS.findall(text))
    symbols, ends = len(SYMBOLS.findall(text)), len(ENDS.findall(text))
    mean = sum(lengths) / n
    return [
        math.log1p(n),
        mean,
        math.log1p(max(lengths)),
        math.log(len(counts) + 1) / math.log(n + 1),
        counts.most_common(1)[0][1] / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        letters / size,
        len(UPPER.findall(text)) / max(1, letters),
        math.log1p(100 * symbols / size),
        math.log1p(100 * len(LOUD.findall(text)) / size),
        math.log1p(100 * len(DIGITS.findall(text)) / size),
        ends / n,
        math.log1p(100 * text.count("|") / n),
        math.log1p(100 * len(lines) / n),
        1 - len(set(lines)) / max(1, len(lines)),
        math.log(len(zlib.compress(raw, 1)) / len(raw)),
        sum(x == 1 for x in lengths) / n,
        math.sqrt(sum((x - mean) ** 2 for x in lengths) / n),
    ]


def expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.column_stack([z, z**2 / 4, np.abs(z), np.ones(len(z))])


def thresholds(positive: np.ndarray) -> np.ndarray:
    return np.quantile(positive, np.linspace(0.02, 0.8, 79))


def class_prior(positive: np.ndarray, passed: np.ndarray, n: int) -> float:
    """The share of positives among ``n`` unlabelled texts: least upper bound on P(u >= t) / P(p >= t), from how many pass each threshold."""
    best = 1.0
    for t, count in zip(thresholds(positive), passed, strict=True):
        p, u = (positive >= t).mean(), count / n
        slack = math.sqrt(u * (1 - u) / n) + math.sqrt(p * (1 - p) / len(positive))
        best = min(best, (u + slack) / p)
    return float(min(max(best, 0.02), 0.99))


def non_negative_risk(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, ridge: float = 1e-4) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk; where its second term is negative, that term is climbed instead."""
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    w[-1] = math.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        fp, fu = np.einsum("ij,j->i", p, w), np.einsum("ij,j->i", u, w)
        sp, su = 1 / (1 + np.exp(-np.clip(fp, -30, 30))), 1 / (1 + np.exp(-np.clip(fu, -30, 30)))
        # losses: for label + it is 1 - s, for label - it is s; both have slope s (1 - s)
        negative = su.mean() - prior * sp.mean()
        dp, du = np.einsum("ij,i->j", p, sp * (1 - sp)) / len(p), np.einsum("ij,i->j", u, su * (1 - su)) / len(u)
        gradient = -prior * dp + (du - prior * dp if negative >= 0 else prior * dp - du) + ridge * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), 0.5)
        f = np.einsum("ij,j->i", expanded(rows, self.mean, self.scale), self.weights)
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([statistics(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64()))], names=["doc_id", "x"])

    ship_code(docs.sparkSession)
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>"), "statistics")


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every statistic over all rows, to nine digits: the order of sums doesn't show."""
    wanted = [f(F.get("x", F.lit(i))) for i in range(N_FEATURES) for f in (F.avg, F.stddev_pop)]
    got = np.array([float(f"{v or 0.0:.9g}") for v in rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(wanted)]).first()])
    return got[::2], np.maximum(got[1::2], 1e-3)


def passing(rows: DataFrame, score: Callable[[np.ndarray], np.ndarray], bounds: np.ndarray) -> tuple[np.ndarray, int]:
    """How many rows score at least each bound, and how many there are; a row a task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(bounds), dtype=np.int64), 0
        for batch in batches:
            if batch.num_rows:
                counts += (score(_matrix(batch.column("x"))) >= bounds[:, None]).sum(axis=1)
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([[*counts.tolist(), n]], pa.list_(pa.int64()))], names=["n"])

    got = rows.select("x").mapInArrow(run, "n array<long>").select(F.posexplode("n")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    found = np.zeros(len(bounds) + 1, dtype=np.int64)
    for r in got:
        found[r["pos"]] = r["n"]
    return found[:-1], int(found[-1])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def _sorted(x: np.ndarray) -> np.ndarray:
    """Tasks end in any order; sums shouldn't depend on it."""
    return x[np.lexsort(x.T)] if len(x) else x


def learn(positive: np.ndarray, unlabelled: np.ndarray, rest: DataFrame, mean: np.ndarray, scale: np.ndarray) -> Model:
    """``rest``: the unlabelled rows that the ranking classifier hasn't seen."""
    p, u = expanded(positive, mean, scale), expanded(unlabelled, mean, scale)
    prior = NO_PRIOR
    if min(len(p), len(u)) > 20:
        seen = np.concatenate([p[::2], u])[:, :-1]
        ranker = fit_logistic(seen, np.concatenate([np.ones(len(p[::2])), np.zeros(len(u))]), ridge=1e-3)
        held = ranker.score(p[1::2, :-1])
        passed, n = passing(rest, lambda x: ranker.score(expanded(x, mean, scale)[:, :-1]), thresholds(held))
        prior = class_prior(held, passed, n) if n > 20 else NO_PRIOR
    return Model(mean, scale, non_negative_risk(p, u, prior), prior)


def fit(rows: DataFrame, labels: DataFrame, train: Column) -> Model:
    """``rows`` are described documents."""
    trusted = labels.filter(F.col("doc_id").isNotNull()).filter(train).groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).filter("q = 1").select("doc_id")
    trusted = materialize(trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_POSITIVES), "trusted")
    rows = rows.filter(train)
    n = rows.count()
    share = min(0.5, MAX_UNLABELLED / max(1, n))  # the others count for the prior
    picked = F.pmod(F.xxhash64(F.lit("unlabelled"), "doc_id"), F.lit(1_000_003)) < share * 1_000_003
    positive = rows.join(F.broadcast(trusted), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"))
    sample = rows.filter(picked).groupBy("doc_id").agg(F.min("x").alias("x"))
    p, u = (_sorted(np.array(part.select("x").toPandas()["x"].tolist()).reshape(-1, N_FEATURES)) for part in (positive, sample))
    if not len(p) or not len(u):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), None, NO_PRIOR)
    return learn(p, u, rows.filter(~picked), *moments(rows))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of described rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch.column("x"))))], names=["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    rows = described(docs)
    model = fit(rows, labels, remainder(4) != 2)
    return score(rows, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


SQL = None
