"""A document classifier combined with what its host and path are like, by hierarchical empirical Bayes.

A logistic model over the presence of telling words and word beginnings and a few figures of the text gives each
document's evidence.
Grouped aggregation of that evidence gives the rate of bad documents of all the corpus, of each host and of each path
of a host. Rates of sparse groups are shrunk: a path's toward its host's, a host's toward the corpus's, by an amount
that is estimated from how much the groups differ. A document's evidence is then read with its path's rate as prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .texthash import slices, word_hashes

#: Labelled documents that the model is fitted on (those with the least hashes of their ids), and words that it may use.
SAMPLE, WORDS, LEAST_DOCS = 20_000, 400, 12
#: Word beginnings of so many bytes count like words, for languages that inflect and compound.
PREFIXES = (6, 7, 8)
FIGURES = ("capitals", "signs", "shouts", "digits", "sameness", "word_length")


def _figures(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Share of capitals, signs, exclamation marks and digits in the bytes, of repeated words, and word length / 10."""
    size = np.maximum(1, np.diff(offsets)).astype(float)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    n = np.diff(index)
    own = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, own))
    new = np.ones(len(own), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (own[order][1:] != own[order][:-1])
    distinct = np.bincount(own[order][new], minlength=len(n))
    signs = np.isin(data, np.frombuffer(b"#*$%&|<>@^~=+_{}[]\\/", np.uint8))
    columns = [count((data >= 65) & (data <= 90)) / size, count(signs) / size, count(data == 33) / size, count((data >= 48) & (data <= 57)) / size, 1 - distinct / np.maximum(1, n), size / np.maximum(1, n) / 10]
    return np.minimum(np.stack(columns, axis=1), 10.0)


def _word_and_prefix_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of hashes for the words and one for each length of prefix, and the index of each text's first word."""
    hashes, index = word_hashes(data, offsets)
    return np.stack([hashes, *(word_hashes(data, offsets, p)[0] for p in PREFIXES)]), index


def _present(hashes: np.ndarray, index: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the known words and beginnings (sorted hashes) each text has."""
    n = len(index) - 1
    out = np.zeros((n, len(known)), bool)
    for row in hashes if len(known) else ():
        at = np.searchsorted(known, row)
        at[at == len(known)] = 0
        hit = np.flatnonzero(known[at] == row)
        out[np.searchsorted(index, hit, "right") - 1, at[hit]] = True
    return out


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in slices(batch.column(0)):
            hashes, index = _word_and_prefix_hashes(data, offsets)
            bad = np.asarray(batch.column(1))[first : first + len(offsets) - 1]
            for i in range(len(bad)):
                own = np.unique(hashes[:, index[i] : index[i + 1]]).view(np.int64)
                yield pa.record_batch({"word": pa.array(own), "bad": pa.array(np.full(len(own), bad[i], np.int32))})


def _features(known: np.ndarray, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for first, data, offsets in slices(column):
        hashes, index = _word_and_prefix_hashes(data, offsets)
        yield first, np.concatenate([_present(hashes, index, known).astype(float), _figures(data, offsets, hashes[0], index)], axis=1)


def with_site(docs: DataFrame, url_col: str = "url", host_col: str = "host", path_col: str = "path") -> DataFrame:
    """``docs`` with the host of each url, in small letters, and the first part of its path ('' if it has none). A null
    url, and what is no url, has null for both."""
    url = F.col(f"`{url_col}`").cast("string")
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/*([^/?#]*)", 1)
    known = host != ""
    return docs.withColumns({host_col: F.when(known, host), path_col: F.when(known, path)})


@dataclass
class Model:
    words: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    rate: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + (x - self.centre) / self.scale @ self.weights[1:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T * np.maximum(p * (1 - p), 1e-6) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = WORDS) -> Model:
    """The document model. A document is bad if a label says quality 0 or toxic 1.

    ``sample`` bounds the labelled documents used, ``words`` the words that the model looks at: those whose presence
    tells most (by the lower end of their log odds) in LEAST_DOCS documents or more. Labels of one class give a model
    that always answers that class's rate.
    """
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    known = labels.where("doc_id is not null").select("doc_id", bad.alias("bad")).where("bad is not null").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "bad")
    rows = written(rows, "labelled")
    totals = {r.bad: r["count"] for r in rows.groupBy("bad").count().collect()}
    n_bad, n_good = totals.get(1, 0), totals.get(0, 0)
    rate = (n_bad + 0.5) / (n_bad + n_good + 1)
    if not n_bad or not n_good:
        k = len(FIGURES)
        return Model(np.zeros(0, np.uint64), np.zeros(k), np.ones(k), np.append(np.log(rate / (1 - rate)), np.zeros(k)), rate)
    counts = rows.mapInArrow(_distinct_words, "word long, bad int").groupBy("word").agg(F.sum("bad").alias("b"), F.sum(1 - F.col("bad")).alias("g")).where(F.col("b") + F.col("g") >= LEAST_DOCS)
    odds = F.log((F.col("b") + 0.5) / (n_bad - F.col("b") + 0.5)) - F.log((F.col("g") + 0.5) / (n_good - F.col("g") + 0.5))
    error = F.sqrt(1 / (F.col("b") + 0.5) + 1 / (F.col("g") + 0.5))
    telling = counts.select("word", (F.abs(odds) - 2.5 * error).alias("t")).where("t > 0").orderBy(F.desc("t"), "word").limit(words)
    kept = np.sort(np.array([r.word for r in telling.collect()], np.int64).view(np.uint64))

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in _features(kept, batch.column(0)):
                yield pa.record_batch({"x": pa.array([r.astype("<f4").tobytes() for r in x], pa.binary()), "bad": batch.column(1).slice(first, len(x))})

    found = rows.mapInArrow(matrix, "x binary, bad int").collect()  # at most ``sample`` rows of ``words`` + 6 numbers
    x = np.stack([np.frombuffer(r.x, "<f4") for r in found]).astype(float)
    y = np.array([r.bad for r in found], float)
    order = np.lexsort((*x.T[:3], y))  # the same sums whatever order the rows came in
    x, y = x[order], y[order]
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    return Model(kept, centre, scale, _logistic((x - centre) / scale, y), float(y.mean()))


def score(docs: DataFrame, model: Model, host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """(doc_id, host, path, evidence): the model's log odds that a document is bad."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in _features(model.words, batch.column(3)):
                part = batch.slice(first, len(x))
                yield pa.record_batch({"doc_id": part.column(0), "host": part.column(1), "path": part.column(2), "evidence": pa.array(model.logit(x))})

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{path_col}`").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, host string, path string, evidence double")


def _strength(groups: DataFrame, parent: str) -> float:
    """Pseudo-counts for shrinking groups (n, s: rows and summed probabilities) toward the rates in column ``parent``.

    By moments: the groups' rates vary by tau squared beyond what their sizes explain; a Beta law with that variance
    around rate m has m (1 - m) / tau squared - 1 pseudo-counts.
    """
    m = F.col(parent)
    row = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - m, 2)).alias("q"), F.sum(m * (1 - m)).alias("noise"), F.sum(F.col("n") * m * (1 - m)).alias("v")).first()
    if not row or not row.n or not row.v:
        return 1.0
    tau2 = max(0.0, (row.q - row.noise) / row.n)
    return float(min(1e6, max(1.0, row.v / row.n / tau2 - 1))) if tau2 > 0 else 1e6


def classify(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", cut: float = 0.5, model: Model | None = None) -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, p_bad, kept) of each row of ``docs``.

    evidence is the document model's probability; p_bad its product with the path's prior; kept if p_bad < cut. A null
    or empty text has the evidence that the model gives to no words. Null hosts and paths are groups of their own.
    Rows that repeat are scored alike, and each counts in its groups. An empty table gives no rows. Extra columns are
    ignored.
    """
    model = model or fit(docs, labels)
    p = lambda x: 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))
    scored = written(score(docs, model, host_col, path_col).withColumn("p", p(F.col("evidence"))), "scored")
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    paths = written(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = (whole.s or 0.0) / (whole.n or 1)
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    hosts = hosts.withColumn("m", F.lit(rate))
    k = _strength(hosts, "m")
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("s") + k * rate) / (F.col("n") + k)).alias("host_rate"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k = _strength(paths, "host_rate")
    paths = paths.select(F.col("host").alias("h"), F.col("path").alias("q"), "host_rate", ((F.col("s") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate"))
    out = scored.join(paths, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    shift = F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - float(np.log(rate / (1 - rate)))
    out = out.withColumn("p_bad", p(F.col("evidence") + shift))
    return out.select("doc_id", F.col("p").alias("evidence"), "host_rate", "path_rate", "p_bad", (F.col("p_bad") < cut).alias("kept"))
