"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1.  For each bit a binary classifier over hashed character
n-grams (orders 1 to 3 of lower-cased letters, anything else is a blank) tells the languages with +1
from those with -1: its margin is the mean log-odds of the text's n-grams, scaled by a logistic fit.
A text gets the language whose codeword has the least weighted loss, the sum over bits of
weight x exp(-bit x margin), a bit's weight being its accuracy above chance on the rows it was fitted
on.  If the second codeword is nearly as close, the text is flagged as ambiguous: the gap of their
weighted sums of margins is far under the gaps of the labelled texts that were fitted on.

Up to seven languages get the exhaustive code (every split of the languages once); more get random
dense codewords of 10 log2(languages) bits from a fixed seed, far apart by choice among candidates.

Fitting reads at most about FIT_ROWS rows of each language, chosen by a hash of their id; prediction
covers every row.

Defined results: null texts and texts without a letter are `und` with score 0; without labelled rows
every text is `und`; repeated rows and ids are predicted each by their text; ties go to the language
that sorts first; columns other than text are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, remainder, sampled, ship, trimmed
from .steps import steps

BUCKETS, ORDERS, FIT_ROWS = 1 << 15, (1, 2, 3), 4000
#: A text is ambiguous if its gap is under this part of the gap that 99 of 100 fitted texts reach.
AMBIGUOUS = 0.6
_SLICE, _STEP = 1 << 18, 1 << 18
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def has_letter(text: str) -> bool:
    """Whether n-grams see more than blanks in a text."""
    return any(map(str.isalpha, text.lower()))


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of the n-grams of texts, in slices."""
    codes, owner = [], []
    for k, text in enumerate(texts):
        c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
        codes.append(np.where(_is_letter()[c], c, 32))
        owner.append(np.full(len(c), k, np.int32))
    code, own = np.concatenate(codes).astype(np.uint64), np.concatenate(owner)
    for n in ORDERS:
        for a in range(0, len(code) - n + 1, _SLICE):
            b = min(a + _SLICE, len(code) - n + 1)
            h = np.full(b - a, n, np.uint64)
            for k in range(n):
                h = (h ^ code[a + k : b + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            whole = own[a:b] == own[a + n - 1 : b + n - 1]
            yield own[a:b][whole], (h >> np.uint64(17)).astype(np.int64)[whole] % BUCKETS


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """One row of +1 and -1 for each language."""
    if languages <= 1:
        return np.ones((languages, 1), np.int8)
    if languages <= 7:
        bits = [[1, *[1 if s >> k & 1 else -1 for k in range(languages - 1)]] for s in range(2 ** (languages - 1) - 1)]
        return np.array(bits, np.int8).T
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, int(np.ceil(10 * np.log2(languages)))))
        if (np.abs(code.sum(0)) == languages).any():
            continue
        far = min(int((code[i] != code[j]).sum()) for i in range(languages) for j in range(i))
        if far > apart:
            best, apart = code, far
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    odds: np.ndarray  # bits x buckets
    scale: np.ndarray
    shift: np.ndarray
    weight: np.ndarray
    counts: dict = field(default_factory=dict)
    least_gap: float = 0.0

    def gaps(self, margins: np.ndarray) -> np.ndarray:
        """How far the best codeword is ahead of the second, in weighted sums of margins; never saturated."""
        fit = np.sort((margins * self.weight) @ self.code.T, 1)
        return fit[:, -1] - fit[:, -2]

    def margins(self, texts: list[str]) -> np.ndarray:
        total, n = np.zeros((len(texts), len(self.odds))), np.zeros(len(texts))
        for own, bucket in grams(texts):
            n += np.bincount(own, minlength=len(texts))
            for b, odds in enumerate(self.odds):
                total[:, b] += np.bincount(own, odds[bucket], len(texts))
        return total / np.maximum(n, 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores from 0 to 1, ambiguity."""
        claim("languages")
        lang, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        at = [k for k, t in enumerate(texts) if t and has_letter(t)]
        if not at or not self.languages:
            return lang, score, unsure
        raw = self.margins([texts[k] for k in at]) * self.scale + self.shift
        m = np.clip(raw, -8, 8)
        loss = (self.weight * np.exp(-self.code[None, :, :] * m[:, None, :])).sum(2)
        share = np.exp(-(loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        for k, i, s in zip(at, share.argmax(1), share):
            lang[k], score[k] = self.languages[i], s[i]
        if len(self.languages) > 1:
            unsure[at] = self.gaps(raw) < self.least_gap
        return lang, score, unsure


def fit(docs: DataFrame, rows: Column | None = None, most: int = FIT_ROWS, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """Fit on the labelled rows for which `rows` holds, at most about `most` of each language."""
    ship(docs.sparkSession)
    good = F.col(f"`{lang_col}`").isNotNull() & (F.col(f"`{lang_col}`") != "und") & (rows if rows is not None else F.lit(True))
    table = docs.where(good).select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"))
    there = {r["lang"]: r["n"] for r in table.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    languages = sorted(there)
    code = codewords(len(languages))
    if not languages:
        return LanguageModel([], code, np.zeros((1, BUCKETS)), np.ones(1), np.zeros(1), np.ones(1))
    number = {x: k for k, x in enumerate(languages)}
    chosen = table.where(reduce(lambda c, x: c.when(F.col("lang") == x, sampled(F.col("h"), most / there[x])), languages[1:], F.when(F.col("lang") == languages[0], sampled(F.col("h"), most / there[languages[0]])))).select("lang", "text", "h")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for some in steps(batch, 1, _STEP):
                lang = np.array([number[x] for x in some.column(0).to_pylist()])
                for own, bucket in grams([x or "" for x in some.column(1).to_pylist()]):
                    counts += np.bincount(lang[own] * BUCKETS + bucket, minlength=counts.size).reshape(counts.shape)
        for k, row in enumerate(counts):
            if row.any():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([k], pa.int32()), "counts": pa.array([row.tobytes()], pa.binary())})

    counts = np.zeros((len(languages), BUCKETS))
    for r in chosen.repartition(8).mapInArrow(count, "lang int, counts binary").toLocalIterator():  # a row of fixed size for each language and task
        counts[r["lang"]] += np.frombuffer(r["counts"], np.int64)
    p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
    odds = np.stack([np.log(p[c > 0].mean(0)) - np.log(p[c < 0].mean(0)) if (c < 0).any() else np.zeros(BUCKETS) for c in code.T]).astype(np.float32)
    bits = len(odds)
    model = LanguageModel(languages, code, odds, np.ones(bits), np.zeros(bits), np.ones(bits), there)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in steps(batch, 1, _STEP):
                m = model.margins([x or "" for x in some.column(1).to_pylist()])
                lang = [number[x] for x in some.column(0).to_pylist()]
                yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.int32()), "m": pa.array(m.tolist(), pa.list_(pa.float64()))})

    # about `most` rows a language; repeated rows, which share a hash, once
    seen = chosen.dropDuplicates(["lang", "h"]).mapInArrow(margins, "lang int, m array<double>").toPandas()
    if not len(seen):
        raise ValueError(f"no labelled row was sampled of {sum(there.values())}: raise most ({most})")
    m, y = np.array(seen["m"].tolist()), code[seen["lang"].to_numpy()]
    for b in range(bits):
        model.scale[b], model.shift[b] = _logistic(m[:, b], y[:, b])
        right = (np.sign(m[:, b] * model.scale[b] + model.shift[b]) == y[:, b]).mean()
        model.weight[b] = max(1e-3, 2 * right - 1)
    model.weight /= model.weight.mean()
    if len(languages) > 1 and len(m):
        model.least_gap = AMBIGUOUS * float(np.quantile(model.gaps(m * model.scale + model.shift), 0.01))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of y in {-1, +1} on x by Newton steps with a small ridge."""
    spread = x.std() or 1.0
    a, t = np.zeros(2), np.stack([x / spread, np.ones_like(x)], 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(t @ a, -30, 30)))
        g = t.T @ (p - (y > 0)) / len(x) + 1e-3 * a
        h = (t * (p * (1 - p))[:, None]).T @ t / len(x) + 1e-3 * np.eye(2)
        a -= np.linalg.solve(h, g)
    return float(a[0] / spread), float(a[1])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for some in steps(batch, 1, _STEP):
                lang, score, unsure = model.predict(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(lang), pa.array(score), pa.array(unsure)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows, all columns, whose text has a language that is not ambiguous."""
    return keep_rows(docs, text_col, lambda texts: (lambda lang, _, unsure: (np.array(lang) != "und") & ~unsure)(*model.predict(texts)))


def keep_rows(docs: DataFrame, text_col: str, keep) -> DataFrame:
    """Rows of docs, unchanged, for which keep(texts) holds."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for some in steps(batch, at, _STEP):
                yield some.filter(pa.array(np.asarray(keep(some.column(at).to_pylist()), bool)))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def held_out(id_col: str = "doc_id") -> Column:
    return remainder(F.col(f"`{id_col}`"), 4) == 2
