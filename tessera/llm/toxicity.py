"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Terms (words, and word beginnings of 4 to 6 letters) are counted by label on a bounded sample of
   labelled rows; those that go with a label become the vocabulary.  A toxic term needs a fixed small
   number of texts and a test of significance, no share of the toxic texts.
2. Voters: the toxic words dealt into WORD_VOTERS lexicons, toxic beginnings of each length as
   patterns, harmless words in HARMLESS_VOTERS lexicons, the absence of any toxic term, shouting, and
   the label itself as one more voter that may err.  A voter says toxic, harmless or nothing.
3. The label model gives each voter a distribution of votes for each class and is fitted by expectation
   maximisation.  Voters that agree beyond what their class explains are correlated: each one's
   evidence is divided by its summed correlation with the others, so that copies of a voter count once.
   The label is not read from the text, so it keeps its whole weight; its accuracy is estimated with a prior of
   LABEL_ACCURACY, which also settles which class is which if all other voters are copies of one.
4. A logistic classifier on the vocabulary is trained on the posterior labels and scores every text.

Fitting reads at most about FIT_TOXIC toxic and FIT_HARMLESS other rows, chosen by a hash of their id;
scoring covers every row and whole texts.

Defined results: null and empty texts get the score of the intercept; without labelled rows, or with
one class only, the score is the share of that label (0.0 without any); repeated rows score alike;
columns other than text are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, cut, drop, remainder, sampled, ship, trimmed
from .langid import keep_rows
from .neardup import shingles
from .steps import steps

FIT_TOXIC, FIT_HARMLESS = 6000, 12000
#: Toxic terms all stay, whatever their number; harmless ones take a quarter of this at most.
VOCABULARY = 4000
#: A toxic term is this many times as frequent in toxic texts, and occurs in at least SUPPORT of them.  The
#: count is the same at every size: a share would shut out a language that has few of the toxic texts.
LEAN, SUPPORT = 15, 5
WORD_VOTERS, HARMLESS_VOTERS, LABEL_ACCURACY = 8, 3, 0.9
_BEGINNINGS = (4, 5, 6)
_STEP = 1 << 20
_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"\b[^\W\d_a-z]{3,}!")


def terms(text: str | None) -> set[str]:
    """Words of a text and their beginnings (marked by a closing star)."""
    words = set(_WORD.findall((text or "").lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in _BEGINNINGS)) if words else words


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    intercept: float
    voters: list[str]
    accuracy: np.ndarray
    correlation: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        claim("toxicity")
        weights, known, out = self.weights, {}, []
        for text in texts:
            found: set[str] = set()
            for w in set(_WORD.findall((text or "").lower())):
                hit = known.get(w)
                if hit is None:
                    hit = known[w] = [t for t in (w, *(w[:n] + "*" for n in _BEGINNINGS if len(w) > n)) if t in weights]
                if hit:
                    found.update(hit)
            out.append(self.intercept + sum(sorted(weights[t] for t in found)))
        return 1 / (1 + np.exp(-np.clip(np.array(out), -30, 30)))


def label_model(votes: np.ndarray, share: float, rounds: int = 30, anchor: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """votes: rows x voters in {-1, 0, 1}.  Returns posterior of label 1, accuracy by voter, correlations.

    anchor: a voter that is independent of the others and right with about LABEL_ACCURACY.
    """
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    with np.errstate(all="ignore"):
        raw = np.nan_to_num(np.corrcoef(votes.T.astype(float)).reshape(votes.shape[1], -1))
    if anchor is not None:
        raw[anchor], raw[:, anchor] = 0, 0
    discount, corr = 1 / np.clip((np.clip(raw, 0, 1) ** 4).sum(0), 1, None), np.eye(votes.shape[1])  # copies start as one voter
    q = 1 / (1 + np.exp(-(2 * votes @ discount + np.log(share / (1 - share)) / 2)))
    for k in range(rounds):
        on = np.stack([np.einsum("r,rvk->vk", 1 - q, one_hot) + 0.5, np.einsum("r,rvk->vk", q, one_hot) + 0.5])
        if anchor is not None:  # the prior counts as much as the votes
            wrong = (1 - LABEL_ACCURACY) / 2
            on[:, anchor] += on[:, anchor].sum(1, keepdims=True) * np.array([[LABEL_ACCURACY, wrong, wrong], [wrong, wrong, LABEL_ACCURACY]])
        on /= on.sum(2, keepdims=True)
        evidence = np.einsum("rvk,vk->rv", one_hot, np.log(on[1]) - np.log(on[0]))
        if k in (5, 15):  # votes without what the class explains, then how far they still go together
            expected = np.einsum("r,v->rv", 1 - q, on[0] @ [-1, 0, 1]) + np.einsum("r,v->rv", q, on[1] @ [-1, 0, 1])
            left = votes - expected
            sd = np.sqrt((left**2).mean(0)) + 1e-9
            corr = (left.T @ left) / len(left) / np.outer(sd, sd)
            if anchor is not None:
                corr[anchor], corr[:, anchor] = 0, 0
            discount = np.minimum(1 / np.clip(np.where(corr > 0.2, corr, 0).sum(0), 1, None), 1 / np.clip((np.clip(raw, 0, 1) ** 4).sum(0), 1, None))
        z = evidence @ discount + np.log(share / (1 - share))
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    right = (on[1][:, 2] * share + on[0][:, 0] * (1 - share)) / ((on[1][:, 2] + on[1][:, 0]) * share + (on[0][:, 0] + on[0][:, 2]) * (1 - share))
    return q, right, corr


def _logistic(rows: list[np.ndarray], size: int, target: np.ndarray, ridge: float = 1e-5, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model of binary features on soft targets, by Adam."""
    col, row = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b, m, v = np.zeros(size + 1), 0.0, np.zeros(size + 1), np.zeros(size + 1)
    for k in range(1, rounds + 1):
        z = np.bincount(row, w[col], len(rows)) + w[size]
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.append(np.bincount(col, e[row], size), e.sum()) / len(rows)
        g[:size] += ridge * w[:size]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w[:size], float(w[size])


def _surprise(a: int, b: int, n1: int, n0: int) -> float:
    """Root of twice the log likelihood ratio of a and b against equal rates; of few texts z says too little."""
    whole = (a + b) / (n1 + n0)
    return np.sqrt(max(0.0, 2 * sum(x * np.log(x / (n * whole)) for x, n in ((a, n1), (b, n0)) if x)))


def _choose(counts: dict[str, tuple[int, int]], n1: int, n0: int) -> tuple[list[str], list[str]]:
    """Terms that go with label 1 and with label 0, the surest first."""
    toxic, harmless = [], []
    for t, (a, b) in counts.items():
        p, q = (a + 0.1) / (n1 + 1), (b + 0.1) / (n0 + 1)
        z = (p - q) / np.sqrt(p * (1 - min(p, 0.99)) / n1 + q * (1 - min(q, 0.99)) / n0)
        if p > LEAN * q and a >= SUPPORT and (z > 3 or _surprise(a, b, n1, n0) > 4):
            toxic.append((-z, t))
        elif q > 1.3 * p and z < -3:
            harmless.append((z, t))
    return [t for _, t in sorted(toxic)], [t for _, t in sorted(harmless)][: VOCABULARY // 4]


def fit(docs: DataFrame, labels: DataFrame, rows: Column | None = None, toxic_rows: int = FIT_TOXIC, harmless_rows: int = FIT_HARMLESS) -> ToxicityModel:
    """Fit on labelled rows for which `rows` (over doc_id) holds."""
    ship(docs.sparkSession)
    marked = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    marked = marked.where(rows) if rows is not None else marked
    there = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = {0: harmless_rows, 1: toxic_rows}
    share = there.get(1, 0) / max(1, sum(there.values()))
    if len(there) < 2:
        return ToxicityModel({}, float(np.log((share + 1e-9) / (1 - share + 1e-9))), [], np.zeros(0), np.eye(0))
    part = F.when(F.col("y") == 1, sampled(F.xxhash64("id"), most[1] / there[1])).otherwise(sampled(F.xxhash64("id"), most[0] / there[0]))
    chosen = marked.where(part).dropDuplicates(["id"])
    # about toxic_rows + harmless_rows ids of 12 bytes: a size fixed by the parameters
    sample = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id").select("id", "y", "text")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in steps(batch, 2, _STEP):
                least = [int(x[0] >> np.uint64(1)) if len(x) else -1 for x in (shingles(t, 5) for t in some.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(least, pa.int64())], names=["id", "y", "text", "least"])

    # most copies of a text share its least shingle hash: they are one example, not many
    sample = cut(sample.mapInArrow(key, "id long, y int, text string, least long").groupBy("least", "y").agg(F.min_by(F.struct("id", "text"), F.struct("id", "text")).alias("d")).select("d.id", "y", "d.text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for some in steps(batch, 2, _STEP):
                for y, text in zip(some.column(1).to_pylist(), some.column(2).to_pylist()):
                    seen[y].update(terms(text))
                    if len(seen[0]) + len(seen[1]) > 400_000:
                        yield from flush(seen)
        yield from flush(seen)

    def flush(seen: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        for y in (0, 1):
            c = seen[y]
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(c)), "a": pa.array([v * y for v in c.values()], pa.int64()), "b": pa.array([v * (1 - y) for v in c.values()], pa.int64())}) if c else pa.RecordBatch.from_pydict({"term": pa.array([], pa.string()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            c.clear()

    counted = sample.mapInArrow(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        raise ValueError(f"no labelled row has a text or was sampled of {sum(there.values())}: raise toxic_rows ({toxic_rows}) and harmless_rows ({harmless_rows})")
    n1, n0 = sizes.get(1, 1), sizes.get(0, 1)
    # terms of the sample that are not rare and lean to a side: bounded as the sample is
    lean = (F.col("a") + 0.1) / n1 / ((F.col("b") + 0.1) / n0)
    counts = {r["term"]: (r["a"], r["b"]) for r in counted.where((F.col("a") >= SUPPORT) & (lean > LEAN) | (F.col("b") >= n0 // 100 + 3) & (lean < 0.75)).collect()}
    toxic, harmless = _choose(counts, n1, n0)
    number = {t: k for k, t in enumerate([*toxic, *harmless])}
    names, group = _voters(toxic, harmless)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in chain.from_iterable(steps(batch, 2, _STEP) for batch in batches):
            found, votes = [], []
            for y, text in zip(some.column(1).to_pylist(), some.column(2).to_pylist()):
                hit = sorted(number[t] for t in terms(text) if t in number)
                found.append(hit)
                votes.append(_vote(hit, text or "", y, group, len(toxic), len(names)))
            yield pa.RecordBatch.from_pydict({"found": pa.array(found, pa.list_(pa.int32())), "votes": pa.array(votes, pa.list_(pa.int32()))})

    seen = sample.mapInArrow(vote, "found array<int>, votes array<int>").toPandas()  # toxic_rows + harmless_rows rows
    found = [np.asarray(x, np.int64) for x in seen["found"]]
    votes = np.array([list(v) for v in seen["votes"]], np.int8).reshape(len(found), len(names))
    own = float((votes[:, -1] == 1).mean())
    posterior, accuracy, corr = label_model(votes, min(0.99, max(0.01, own)), anchor=votes.shape[1] - 1)
    w, b = _logistic(found, len(number), posterior)
    return ToxicityModel({t: float(w[k]) for t, k in number.items() if abs(w[k]) > 1e-3}, b, names, accuracy, corr)


def _voters(toxic: list[str], harmless: list[str]) -> tuple[list[str], list[int]]:
    """Names of the voters, and the voter of each term."""
    names = [f"words {k}" for k in range(WORD_VOTERS)] + [f"beginnings of {n}" for n in _BEGINNINGS] + [f"harmless {k}" for k in range(HARMLESS_VOTERS)] + ["no toxic term", "shouting", "label"]
    group = [WORD_VOTERS + _BEGINNINGS.index(len(t) - 1) if t.endswith("*") else k % WORD_VOTERS for k, t in enumerate(toxic)]
    return names, group + [WORD_VOTERS + len(_BEGINNINGS) + k % HARMLESS_VOTERS for k in range(len(harmless))]


def _vote(hit: list[int], text: str, y: int, group: list[int], n_toxic: int, n: int) -> list[int]:
    votes = [0] * n
    for k in hit:
        votes[group[k]] = 1 if k < n_toxic else -1
    votes[n - 3] = 0 if hit and hit[0] < n_toxic else -1
    votes[n - 2] = 1 if _SHOUT.search(text) else 0
    votes[n - 1] = 1 if y == 1 else -1
    return votes


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for some in steps(batch, 1, _STEP):
                s = model.score(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_harmless(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows, all columns, that are not predicted to be toxic."""
    return keep_rows(docs, text_col, lambda texts: model.score(texts) < 0.5)


def held_out(id_col: str = "doc_id") -> Column:
    return remainder(F.col(f"`{id_col}`"), 5) == 0
