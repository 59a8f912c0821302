"""Language identification: multinomial naive Bayes over hashed character n-grams.

Languages are handled in slices of at most ``SLICE_LANGUAGES``, so that any number of labels, dirty ones too, has a model. For
each slice, training counts n-grams over its training texts: every task adds up a dense (language, bucket) table of fixed size in
numpy and emits its non-zero cells, Spark sums the cells. As log probabilities a slice's table, of fixed size too, is broadcast, and texts are
scored in batches: a batch of texts is a sparse matrix in rows (bucket numbers, and where each text begins), which is multiplied with
the table. What a text has from each slice, its best language and the sum of all odds, meets at the end.

Features are n-grams of 1 to ``MAX_N`` code points over the lower-cased letters of a text, where every run
of other characters counts as one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lumenframe.llm.common import worker_cache

BUCKETS = 1 << 15
MAX_N = 4
#: Code points of text that are handled at once.
SLICE = 1 << 18
#: Cells of the table that are gathered at once.
GATHERED = 1 << 20
UNKNOWN = "und"
#: Languages whose table a task holds at a time.
SLICE_LANGUAGES = 128


class LanguageModel(NamedTuple):
    languages: list[str]
    log_prior: np.ndarray  # languages
    log_prob: np.ndarray  # buckets x languages, float32


class LanguageModels(NamedTuple):
    """Slices of all languages, in alphabetical order."""

    slices: list[LanguageModel]

    @property
    def languages(self) -> list[str]:
        return [name for s in self.slices for name in s.languages]


def _letters(text: str) -> np.ndarray:
    """Lower-cased code points, each run of non-letters one space, a space at either end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = _letter_table()
    letter = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], False)
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays, as a space
    if len(keep) and not letter[-1]:
        keep[np.flatnonzero(letter)[-1:] + 1] = False  # that of the last run is the space at the end
    return np.concatenate(([np.uint32(32)], points[keep], [np.uint32(32)])).astype(np.uint32)


def _letter_table() -> np.ndarray:
    """Which code points are letters."""
    cache = worker_cache()
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return cache["letters"]


def _gram_hashes(points: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Buckets of all n-grams of ``points``, in order."""
    h = np.full(max(0, len(points) - n + 1), n * 0x9E3779B9 & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(n):
        h = (h ^ points[k : k + len(h)]) * np.uint32(0x01000193 + 2 * k)
        h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x85EBCA6B)) >> np.uint32(7)) & np.uint32(buckets - 1)


def _batches(texts: list[str]):
    """(code points of several texts, index of the text of each piece, first point and first owned point of each piece).

    A piece is a text, or at most ``SLICE`` points of a longer one; later pieces repeat the last MAX_N - 1 points of the one before,
    which they don't own.
    """
    held: list[tuple[np.ndarray, int, int]] = []
    size = 0

    def out():
        points = np.concatenate([p for p, _, _ in held])
        starts = np.cumsum([0, *[len(p) for p, _, _ in held]])
        return points, np.array([i for _, i, _ in held]), starts, np.array([o for _, _, o in held])

    for i, text in enumerate(texts):
        points = _letters(text)
        for start in range(0, max(1, len(points) - MAX_N + 1), SLICE):
            piece = points[start : start + SLICE + MAX_N - 1]
            held.append((piece, i, MAX_N - 1 if start else 0))
            size += len(piece)
            if size >= SLICE:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _grams(points: np.ndarray, starts: np.ndarray, owned: np.ndarray, buckets: int):
    """Per n the bucket numbers of all n-grams, in the order of the pieces, and how many each piece has.

    N-grams don't reach from piece to piece; those that lie in the repeated points belong to the piece before.
    """
    for n in range(1, MAX_N + 1):
        h = _gram_hashes(points, n, buckets)
        first = np.minimum(starts[:-1] + np.maximum(0, owned - n + 1), starts[1:])
        end = np.maximum(starts[1:] - n + 1, first)
        inside = np.zeros(len(points) + 1, dtype=np.int8)
        some = end > first
        inside[first[some]] += 1
        inside[end[some]] -= 1
        yield h[np.cumsum(inside[: len(h)]).astype(bool)], end - first


def train(docs: DataFrame, text: Column, lang: Column, buckets: int = BUCKETS, smoothing: float = 0.5, per_slice: int = SLICE_LANGUAGES) -> LanguageModels:
    """Fit on every row whose text and language are not null.

    Rows of a language are not gathered anywhere; the driver gets the languages with their numbers of rows, and the summed
    table slice by slice. Without such rows the model knows no language.
    """
    rows = docs.select(text.alias("text"), lang.alias("lang")).where("text is not null and lang is not null")
    counted = sorted((r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect())
    total = sum(n for _, n in counted)
    slices = []
    for at in range(0, len(counted), per_slice):
        own = counted[at : at + per_slice]
        log_prob = _fit([name for name, _ in own], rows if len(counted) <= per_slice else _between(rows, own[0][0], own[-1][0]), buckets, smoothing)
        slices.append(LanguageModel([name for name, _ in own], np.log(np.array([n for _, n in own]) / total), log_prob))
    return LanguageModels(slices)


def _between(rows: DataFrame, low: str, high: str) -> DataFrame:
    # Python and Spark both compare by code point.
    return rows.where(F.col("lang").between(low, high))


def _fit(languages: list[str], rows: DataFrame, buckets: int, smoothing: float) -> np.ndarray:
    """Log probabilities of one slice, buckets x languages."""
    index = {name: i for i, name in enumerate(languages)}

    def count(batches):
        cells = np.zeros(len(languages) * buckets, dtype=np.int64)
        for batch in batches:
            where = batch["lang"].map(index).to_numpy()
            for points, text, starts, owned in _batches(batch["text"].tolist()):
                for h, sizes in _grams(points, starts, owned, buckets):
                    cells += np.bincount(h + np.repeat(where[text] * buckets, sizes), minlength=len(cells))
        at = np.flatnonzero(cells)
        for part in range(0, len(at), 50_000):
            a = at[part : part + 50_000]
            yield pd.DataFrame({"lang": (a // buckets).astype(np.int32), "bucket": (a % buckets).astype(np.int32), "n": cells[a]})

    sums = rows.mapInPandas(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))  # at most ``buckets`` cells each
    smooth = np.full((len(languages), buckets), float(smoothing))
    for row in packed.collect():
        pairs = np.array([(c["bucket"], c["n"]) for c in row["cells"]], dtype=np.int64)
        smooth[row["lang"], pairs[:, 0]] += pairs[:, 1]
    return (np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True))).T.astype(np.float32).copy()


def score_slice(model: LanguageModel, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the number of its best language, its log odds, and the log of the sum of all odds; no language (-1) without a letter."""
    best, top, whole = np.full(len(texts), -1), np.full(len(texts), -np.inf), np.full(len(texts), -np.inf)
    usable = np.array([i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))], dtype=np.int64)
    if not len(usable):
        return best, top, whole
    totals = np.tile(model.log_prior, (len(usable), 1)).astype(float)
    buckets, known = model.log_prob.shape
    step = max(1, GATHERED // known)
    for points, text, starts, owned in _batches([texts[i] for i in usable]):
        for h, sizes in _grams(points, starts, owned, buckets):
            # Rows of the sparse matrix times the table, as many of its entries at a time as fit.
            row = np.repeat(text, sizes)
            for part in range(0, len(h), step):
                own = row[part : part + step]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                totals[own[first]] += np.add.reduceat(model.log_prob[h[part : part + step]], first, axis=0, dtype=np.float64)
    best[usable] = totals.argmax(axis=1)
    top[usable] = totals.max(axis=1)
    whole[usable] = top[usable] + np.log(np.exp(totals - top[usable, None]).sum(axis=1))
    return best, top, whole


def combined(parts: Iterator[LanguageModel], texts: list) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior probability for each text, from all slices in turn."""
    names, top, whole = [UNKNOWN] * len(texts), np.full(len(texts), -np.inf), np.full(len(texts), -np.inf)
    for model in parts:
        number, own, total = score_slice(model, texts)
        for i in np.flatnonzero(own > top).tolist():  # of equal odds the language of the earlier slice stays
            names[i] = model.languages[number[i]]
        top, whole = np.maximum(top, own), np.logaddexp(whole, total)
    with np.errstate(invalid="ignore"):
        return names, np.where(np.isneginf(top), 0.0, np.exp(top - whole))


def identify(docs: DataFrame, models: LanguageModels, text: str = "text", to: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior probability, from the whole text alone.

    A null text, or one without a letter, gets ``und`` and score 0, as does every text when the model knows no
    language. Equal odds go to the language first in alphabetical order. Other columns pass through; names that clash with
    ``to`` or ``score`` are replaced. An empty table gives an empty result. With many languages a task holds one slice at a time.
    """
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(tuple(m)) for m in models.slices]  # SLICE_LANGUAGES x buckets cells each

    def slices():
        for part in shared:
            yield LanguageModel(*part.value)
            if len(shared) > 1:
                vars(part).pop("_value", None)  # else the worker would keep all slices

    def run(batches):
        for texts in batches:
            names, scores = combined(slices(), texts.tolist())
            yield pd.DataFrame({"to": names, "score": scores})

    kind = StructType([StructField("to", StringType()), StructField("score", DoubleType())])
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    guess = F.pandas_udf(run, kind)
    kept = [c for c in docs.columns if c not in (to, score, "__guess")]
    return docs.select(*kept, guess(F.col(text)).alias("__guess")).select(
        *kept, F.col("__guess.to").alias(to), F.col("__guess.score").alias(score)
    )
