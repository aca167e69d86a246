"""Language identification with a string kernel: presence of n-grams of blended lengths, Nystroem landmarks, kernel ridge.

The kernel of two texts is the number of hashed n-grams (1 to 3 characters, all lengths together) that
both have, over the geometric mean of the numbers each has. Landmarks of every language map a text to a
few hundred kernel values; one-versus-rest ridge regression on the Nystroem features scores the languages. A batch of
texts is scored by two matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LENGTHS = (1, 2, 3)
BUCKETS = 1 << 18
#: Texts and landmarks of each language that train; beyond ``LANGUAGES`` languages each has fewer, and none is left out.
LANGUAGES, TEXTS, LANDMARKS = 64, 300, 40
#: N-grams of a training text that go to the driver at most, those of lowest number.
SAMPLE_GRAMS = 16_384
RIDGE = 1e-3
ROWS, CHARACTERS = 128, 2_000_000
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and bucket of every n-gram of a batch, repeats included, and which texts have a letter.

    Texts are lower-cased; all that is not a letter counts as a space, and runs of it as one.
    """
    lowered = [(t or "").lower() for t in texts]
    owner = np.repeat(np.arange(len(lowered), dtype=np.int32), [len(t) for t in lowered])
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[np.minimum(codes, 0x10FFFF)]
    has = np.zeros(len(lowered), bool)
    has[owner[letter]] = True
    codes = np.where(letter, codes, 0).astype(np.uint32)
    keep = letter.copy()
    if len(keep):
        keep[0] = True
        keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    codes, owner = codes[keep], owner[keep]
    rows, buckets = [], []
    mixed = np.zeros(len(codes), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        mixed = (mixed[:size] ^ codes[n - 1 :]) * np.uint32(0x9E3779B1) + np.uint32(n)
        mixed ^= mixed >> np.uint32(15)
        if n in LENGTHS:
            whole = owner[:size] == owner[n - 1 :]
            rows.append(owner[:size][whole])
            buckets.append((mixed[whole] * np.uint32(0x85EBCA77)) >> np.uint32(14))
    empty = np.empty(0, np.int64)
    return np.concatenate(rows or [empty]), np.concatenate(buckets or [empty]), has


@dataclass
class Model:
    """Landmarks as a 0/1 matrix over the buckets that occur in them, and the weights of the languages."""

    languages: list[str]
    kinds: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def values(self, seen: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Kernel of texts and landmarks: shared n-grams over the geometric mean of all that either has; ``seen`` has the known ones."""
        norms = np.sqrt(np.maximum(counts, 1))[:, None] * np.sqrt(np.maximum(self.landmarks.sum(axis=1), 1))[None, :]
        return seen @ self.landmarks.T / norms.astype(np.float32)

    def kernel(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        rows, buckets, has = presence(texts)
        every = np.zeros((len(texts), BUCKETS), bool)
        every[rows, buckets] = True
        return self.values(every[:, self.kinds].astype(np.float32), every.sum(axis=1)), has

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The best language of each text and its score; ``und`` and 0 for texts without letters."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        values, has = self.kernel(texts)
        scores = np.hstack([values, np.ones((len(texts), 1), np.float32)]) @ self.weights
        best = scores.argmax(axis=1)
        return [(self.languages[b], float(min(max(s[b], 0.0), 1.0))) if h else (UNKNOWN, 0.0) for b, s, h in zip(best, scores, has, strict=True)]


def share(most: int, languages: int) -> int:
    """How many of ``most`` texts or landmarks a language has among so many languages."""
    return max(1, min(most, most * LANGUAGES // languages))


def grams_of(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct buckets of each text's n-grams, in order."""
    rows, buckets, _ = presence(texts)
    cells = np.unique(rows.astype(np.int64) * BUCKETS + buckets)
    return np.split((cells % BUCKETS).astype(np.int32), np.searchsorted(cells, np.arange(1, len(texts)) * BUCKETS)) if texts else []


def fit(texts: list[str], langs: list[str]) -> Model:
    """As :func:`fit_grams`, from texts."""
    return fit_grams([g for i in range(0, len(texts), ROWS) for g in grams_of(texts[i : i + ROWS])], langs)


def fit_grams(grams: list[np.ndarray], langs: list[str]) -> Model:
    """Kernel ridge on Nystroem features of sets of n-grams; the first of each language are landmarks."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.empty(0, np.int64), np.empty((0, 0), np.float32), np.empty((0, 0), np.float32))
    of: dict[str, list[int]] = {lang: [] for lang in languages}
    for k, x in enumerate(langs):
        of[x].append(k)
    marks = [i for lang in languages for i in of[lang][: share(LANDMARKS, len(languages))]]
    kinds = np.unique(np.concatenate([grams[i] for i in marks])).astype(np.int64)

    def seen(chosen: list[int]) -> np.ndarray:
        out = np.zeros((len(chosen), len(kinds)), np.float32)
        for row, i in enumerate(chosen):
            out[row, np.searchsorted(kinds, np.intersect1d(kinds, grams[i]))] = 1
        return out

    model = Model(languages, kinds, seen(marks), np.empty((0, 0), np.float32))
    counts = np.array([len(g) for g in grams])
    values, vectors = np.linalg.eigh(model.values(model.landmarks, counts[marks]).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    every = [list(range(i, min(i + ROWS, len(grams)))) for i in range(0, len(grams), ROWS)]
    features = np.vstack([model.values(seen(part), counts[part]) for part in every]).astype(np.float64) @ root
    features = np.hstack([features, np.ones((len(grams), 1))])
    target = (np.array(langs)[:, None] == np.array(languages)[None, :]).astype(np.float64)
    weight = np.array([len(langs) / (len(languages) * len(of[x])) for x in langs])[:, None]
    solved = np.linalg.solve(features.T @ (features * weight) + RIDGE * len(grams) * np.eye(features.shape[1]), features.T @ (target * weight))
    model.weights = np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32)
    return model


def train(labelled: DataFrame) -> Model:
    """A model from ``labelled(doc_id, text, lang)``: about ``TEXTS`` texts, or fewer the more languages there are, chosen by hash, of every language.

    N-grams are taken on the executors; of a text at most ``SAMPLE_GRAMS`` go to the driver.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").count()
    languages = counts.count()
    if not languages:
        return fit([], [])
    spread = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30)) / float(1 << 30)
    texts = share(TEXTS, languages)
    wanted = texts if languages <= LANGUAGES else texts + 30  # so that chance leaves no language out
    sample = rows.join(F.broadcast(counts), "lang").withColumn("_s", spread).where(F.col("_s") < F.lit(float(wanted)) / F.col("count"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("_s", "text"))
    chosen = sample.withColumn("_n", first).where(F.col("_n") <= wanted).select("lang", "_n", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 2):
                grams = [g[:SAMPLE_GRAMS] for g in grams_of(part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(grams, pa.list_(pa.int32()))], ["lang", "n", "grams"])

    found = sorted(((r["lang"], r["n"], r["grams"]) for r in chosen.mapInArrow(run, "lang string, n int, grams array<int>").toLocalIterator()), key=lambda r: r[:2])
    order = np.random.default_rng(11).permutation(len(found))
    return fit_grams([np.array(found[i][2], np.int32) for i in order], [found[i][0] for i in order])


def held_out(doc_id: Column) -> Column:
    """Whether a document is only for tests: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred and score.

    Learns from rows that aren't held out. Null, empty and letterless texts are ``und`` with score 0; so is
    every text where there is nothing to learn from. Ties go to the language first in order; repeated rows are
    predicted each; no rows give none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(train(rows.where(~held_out(F.col("doc_id")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 2):
                found = model.value.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def portions(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``ROWS`` rows and about ``CHARACTERS`` bytes of text."""
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(at)]
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= ROWS or held + n > CHARACTERS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
