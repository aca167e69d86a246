"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling, over words and their characters.

A word enters as the sum of an embedding of its own, if training has met it often enough, and the
mean of embeddings of its character trigrams. Windows of words overlap and cover a text from end to end;
a text's score is a logistic calibration of its highest window. Training is plain numpy on a bounded sample of labelled
documents: of a toxic document the window that scores highest, of a clean one random windows and its highest.
When scoring, a word's share of the gates' inputs is computed once and remembered.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise
from quillon.llm.langid import held_out

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_SIZE, TRIGRAM_SIZE = 8, 10, 6
TRIGRAMS = 1 << 12
#: Words with embeddings of their own, by how much they tell the classes apart; documents that must have one.
WORDS, LEAST_DOCUMENTS = 6_000, 3
#: Bounds of the training sample, by class, and of its words in all.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_WORDS = 1_500, 3_000, 4_000_000
#: Texts that a class keeps at least when its texts exceed its part of the words, and characters of a span of a text too long for that.
LEAST_TEXTS, SPAN = 100, 2_000
ROUNDS, STEPS, BATCH, RATE = 4, 110, 128, 0.02
MEMO_WORDS = 150_000
ROWS_AT_ONCE, WINDOWS_AT_ONCE = 256, 1_024
CUTOFF = 0.7
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def bare(token: str) -> str:
    """A token without marks and digits around it."""
    return token if token.isalpha() else _EDGES.sub("", token)


def trigram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word number and bucket of every character trigram of each word between marks of its ends."""
    marked = [f"<{w}>" for w in words]
    sizes = np.array([len(w) for w in marked], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < 3:
        return owner[:0], owner[:0]
    whole = owner[2:] == owner[:-2]
    mixed = (codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1]) * np.uint32(0x85EBCA77) ^ codes[2:]
    mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return owner[2:][whole], ((mixed >> np.uint32(16)) % np.uint32(TRIGRAMS))[whole].astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class Net:
    """The network's weights, and its passes forward and backward."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 3):
        draw = np.random.default_rng(seed)
        wide, h = WORD_SIZE + TRIGRAM_SIZE, HIDDEN
        self.vocabulary = vocabulary
        small = lambda *shape: (draw.standard_normal(shape) * 0.3).astype(np.float32)
        self.w = {"word": small(len(vocabulary) + 1, WORD_SIZE) * 0.3, "tri": small(TRIGRAMS, TRIGRAM_SIZE) * 0.5}
        for side in "fb":
            self.w |= {f"x{side}": small(wide, 3 * h), f"u{side}": small(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
        self.w |= {"att": small(2 * h), "out": small(2 * h), "bias": np.zeros(1, np.float32)}
        self.w["word"][0] = 0
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Own number, and trigrams by word: owner, bucket, and one over the word's number of trigrams."""
        own = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        owner, bucket = trigram_buckets(words)
        return own, owner, bucket, (1.0 / np.maximum(np.bincount(owner, minlength=len(words)), 1)).astype(np.float32)

    def vectors(self, made) -> np.ndarray:
        own, owner, bucket, weight = made
        out = np.zeros((len(own), WORD_SIZE + TRIGRAM_SIZE), np.float32)
        out[:, :WORD_SIZE] = self.w["word"][own]
        for k in range(TRIGRAM_SIZE):
            out[:, WORD_SIZE + k] = np.bincount(owner, self.w["tri"][bucket, k], len(own)) * weight
        return out

    def gates(self, vectors: np.ndarray) -> list[np.ndarray]:
        """What words add to the gates of either direction."""
        return [vectors @ self.w[f"x{side}"] + self.w[f"c{side}"] for side in "fb"]

    def forward(self, gates: list[np.ndarray], at: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of windows; ``at`` has the row of ``gates`` of each word, ``mask`` which places hold a word (all if None)."""
        w, h = self.w, HIDDEN
        n, length = at.shape
        states, kept = np.empty((2, length, n, h), np.float32), []
        for side, name in enumerate("fb"):
            u, state = w[f"u{name}"], np.zeros((n, h), np.float32)
            own = gates[side]
            for t in range(length) if side == 0 else range(length - 1, -1, -1):
                x = own[at[:, t]]
                a = state @ u
                zr = _sigmoid(x[:, : 2 * h] + a[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                candidate = np.tanh(x[:, 2 * h :] + r * a[:, 2 * h :])
                new = candidate + z * (state - candidate)
                if mask is not None:
                    new = np.where(mask[:, t, None], new, state)
                if keep:
                    kept.append((side, t, state, a[:, 2 * h :], z, r, candidate))
                states[side, t] = state = new
        energy = states[0] @ w["att"][:h] + states[1] @ w["att"][h:]
        if mask is not None:
            energy = np.where(mask.T, energy, np.float32(-1e4))
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.hstack([np.einsum("tn,tnh->nh", weight, states[s]) for s in (0, 1)])
        logit = pooled @ w["out"] + w["bias"][0]
        return (logit, states, weight, pooled, kept) if keep else logit

    def gradients(self, words: list[str], at: np.ndarray, mask: np.ndarray, target: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss over a batch of windows."""
        w, h = self.w, HIDDEN
        made = self.inputs(words)
        vectors = self.vectors(made)
        logit, states, weight, pooled, kept = self.forward(self.gates(vectors), at, mask, keep=True)
        error = ((1 / (1 + np.exp(-logit)) - target) * importance / importance.sum()).astype(np.float32)
        out = {"out": pooled.T @ error, "bias": np.array([error.sum()], np.float32), "att": np.zeros(2 * h, np.float32)}
        to_pooled = error[:, None] * w["out"]
        to_weight = sum(np.einsum("nh,tnh->tn", to_pooled[:, s * h : (s + 1) * h], states[s]) for s in (0, 1))
        to_energy = weight * (to_weight - (weight * to_weight).sum(axis=0))
        to_gates = np.zeros((len(words), 6 * h), np.float32)
        for s in (0, 1):
            out["att"][s * h : (s + 1) * h] = np.einsum("tn,tnh->h", to_energy, states[s])
        for side, name in enumerate("fb"):
            u, to_u = w[f"u{name}"], np.zeros((h, 3 * h), np.float32)
            carry = np.zeros((len(at), h), np.float32)
            for _, t, state, inner, z, r, candidate in reversed([k for k in kept if k[0] == side]):
                given = carry + weight[t][:, None] * to_pooled[:, side * h : (side + 1) * h] + to_energy[t][:, None] * w["att"][side * h : (side + 1) * h]
                live = mask[:, t, None]
                now = np.where(live, given, 0)
                to_z, to_c = now * (state - candidate), now * (1 - z)
                before_c = to_c * (1 - candidate**2)
                before_z, before_r = to_z * z * (1 - z), before_c * inner * r * (1 - r)
                recurrent = np.hstack([before_z, before_r, before_c * r])
                to_u += state.T @ recurrent
                np.add.at(to_gates[:, side * 3 * h : (side + 1) * 3 * h], at[:, t], np.hstack([before_z, before_r, before_c]))
                carry = np.where(live, now * z + recurrent @ u.T, given)
            part = to_gates[:, side * 3 * h : (side + 1) * 3 * h]
            out |= {f"u{name}": to_u, f"x{name}": vectors.T @ part, f"c{name}": part.sum(axis=0)}
        to_vectors = to_gates[:, : 3 * h] @ w["xf"].T + to_gates[:, 3 * h :] @ w["xb"].T
        own, owner, bucket, scale = made
        out["word"], out["tri"] = np.zeros_like(w["word"]), np.zeros_like(w["tri"])
        np.add.at(out["word"], own, to_vectors[:, :WORD_SIZE])
        out["word"][0] = 0
        np.add.at(out["tri"], bucket, (to_vectors[:, WORD_SIZE:] * scale[:, None])[owner])
        return out


def window_starts(n: int) -> np.ndarray:
    """First words of overlapping windows that cover n words; the last ends with the text."""
    if n <= WINDOW:
        return np.zeros(1 if n else 0, np.int64)
    return np.minimum(np.arange(0, n - WINDOW + STRIDE, STRIDE), n - WINDOW)


class Scorer:
    """Highest window logits of texts; remembers the gate inputs of up to ``MEMO_WORDS`` tokens."""

    def __init__(self, net: Net):
        self.net, self.memo = net, {}
        self.gates = [np.zeros((0, 3 * HIDDEN), np.float32)] * 2

    def numbers(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.memo))
        if new:
            if len(self.memo) + len(new) > MEMO_WORDS and self.memo:
                self.memo.clear()
                self.gates = [g[:0] for g in self.gates]
                new = list(set(words))
            known = len(self.gates[0])
            self.memo.update(zip(new, range(known, known + len(new)), strict=True))
            added = self.net.gates(self.net.vectors(self.net.inputs([bare(w) for w in new])))
            self.gates = [np.vstack(pair) for pair in zip(self.gates, added, strict=True)]
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def windows(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Logits of every text's windows."""
        flat = self.numbers([w for t in texts for w in t])
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        starts = [window_starts(len(t)) for t in texts]
        short = [i for i, t in enumerate(texts) if 0 < len(t) < WINDOW]
        out: list[np.ndarray] = [np.zeros(len(s), np.float32) for s in starts]
        full = [i for i, t in enumerate(texts) if len(t) >= WINDOW]
        if full:
            first = np.concatenate([starts[i] + offsets[i] for i in full])
            logits = np.concatenate([self.net.forward(self.gates, flat[first[k : k + WINDOWS_AT_ONCE, None] + np.arange(WINDOW)], None) for k in range(0, len(first), WINDOWS_AT_ONCE)])
            at = 0
            for i in full:
                out[i] = logits[at : at + len(starts[i])]
                at += len(starts[i])
        if short:
            mask = np.arange(WINDOW) < np.array([len(texts[i]) for i in short])[:, None]
            place = np.minimum(offsets[short][:, None] + np.arange(WINDOW), len(flat) - 1)
            for i, x in zip(short, self.net.forward(self.gates, flat[place], mask), strict=True):
                out[i] = np.array([x])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1 by text, empty ones too (the calibrated score of an empty text is that of the least window)."""
        split = [tokens(t) for t in texts]
        top = np.array([x.max() if len(x) else -8.0 for x in self.windows(split)], np.float64)
        return 1 / (1 + np.exp(-np.clip(self.net.scale * top + self.net.shift, -40, 40)))


def _vocabulary(texts: list[list[str]], toxic: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """Words that tell the classes apart most, and their smoothed log-odds."""
    counts = (Counter(), Counter())
    for words, y in zip(texts, toxic, strict=True):
        counts[int(y)].update({bare(w) for w in words})
    totals = [max(int((toxic == y).sum()), 1) for y in (0, 1)]
    kinds = [w for w in counts[0].keys() | counts[1].keys() if w and counts[0][w] + counts[1][w] >= LEAST_DOCUMENTS]
    odds = {w: np.log((counts[1][w] + 0.2) / (totals[1] + 0.4)) - np.log((counts[0][w] + 0.2) / (totals[0] + 0.4)) for w in kinds}
    spread = {w: abs(odds[w]) * np.sqrt(counts[0][w] + counts[1][w]) for w in kinds}
    best = sorted(kinds, key=lambda w: (-spread[w], w))[:WORDS]
    return {w: i + 1 for i, w in enumerate(best)}, np.array([0.0, *[odds[w] for w in best]], np.float32)


def fit(texts: list[str], toxic: list[int], seed: int = 3) -> Net:
    """Train on labelled texts. With one class only, every text scores that class's side of the cutoff."""
    y = np.array(toxic, np.int64)
    split = [tokens(t) for t in texts]
    vocabulary, odds = _vocabulary(split, y)
    net = Net(vocabulary, seed)
    if len(set(toxic)) < 2:
        net.w["out"][:] = 0
        net.shift = 3.0 if len(y) and y[0] else -3.0
        return net
    net.w["word"][:, 0] = np.clip(odds, -5, 5) / 2
    draw = np.random.default_rng(seed)
    starts = [window_starts(len(t)) for t in split]
    held = [i for i in range(len(split)) if split[i]]
    positive, negative = [i for i in held if y[i]], [i for i in held if not y[i]]
    value = [np.array([odds[vocabulary.get(bare(w), 0)] for w in t], np.float32) for t in split]
    best = {i: int(np.argmax([np.sort(value[i][s : s + WINDOW])[-3:].clip(0).sum() for s in starts[i]])) for i in held}
    first, second = {k: np.zeros_like(v) for k, v in net.w.items()}, {k: np.zeros_like(v) for k, v in net.w.items()}
    step = 0
    for _ in range(ROUNDS):
        for _ in range(STEPS):
            step += 1
            chosen = [*draw.choice(positive, BATCH // 2), *draw.choice(negative, BATCH // 2)]
            spans = [split[i][s : s + WINDOW] for i in chosen for s in [starts[i][best[i] if y[i] or draw.random() < 0.5 else draw.integers(len(starts[i]))]]]
            words = sorted({w for span in spans for w in span})
            number = {w: k for k, w in enumerate(words)}
            mask = np.arange(WINDOW) < np.array([len(s) for s in spans])[:, None]
            at = np.zeros((len(spans), WINDOW), np.int64)
            for k, span in enumerate(spans):
                at[k, : len(span)] = [number[w] for w in span]
            slopes = net.gradients([bare(w) for w in words], at, mask, y[chosen].astype(np.float32), np.ones(len(spans), np.float32))
            rate = RATE * (1 - step / (ROUNDS * STEPS + 1)) + 0.001
            for k, g in slopes.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        scorer = Scorer(net)
        logits = [x for k in range(0, len(split), ROWS_AT_ONCE) for x in scorer.windows(split[k : k + ROWS_AT_ONCE])]
        best = {i: int(np.argmax(logits[i])) for i in held}
    top = np.array([logits[i].max() for i in held], np.float64)
    net.scale, net.shift = _calibrated(top, y[held].astype(np.float64))
    return net


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic regression on softened targets (Platt's), by Newton's method with step halving."""
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    middle, spread = x.mean(), x.std() + 1e-6
    u = np.column_stack([(x - middle) / spread, np.ones_like(x)])
    ridge = np.array([0.1, 1e-6])

    def loss(v: np.ndarray) -> float:
        z = u @ v
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (ridge * v * v).sum())

    v = np.array([1.0, 0.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(u @ v, -40, 40)))
        step = np.linalg.solve((u * (p * (1 - p))[:, None]).T @ u + np.diag(ridge + 1e-9), u.T @ (p - y) + ridge * v)
        size = 1.0
        while size > 1e-4 and loss(v - size * step) > loss(v):
            size /= 2
        v = v - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return float(v[0] / spread), float(v[1] - v[0] * middle / spread)


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """Texts and labels of the training sample: by hash of doc_id, about ``TOXIC_ROWS`` and ``CLEAN_ROWS`` of rows not held out.

    ``SAMPLE_WORDS`` is split between the classes in the proportion of their rows. A class whose texts exceed its part keeps
    fewer of them, chosen by the same hash, but ``LEAST_TEXTS`` at least if it has them; a text of more than that share of
    the part gives spans from all over it. So no order of ids, and no single text, decides what is learned from.
    """
    marks = labels.where("toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    marks = materialise(marks.where(~held_out(F.col("doc_id"))).withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30)) / float(1 << 30)), "marks")
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().toLocalIterator()}
    toxic, clean = sum(n for k, n in counts.items() if k >= 1), sum(n for k, n in counts.items() if k < 1)
    share = F.when(F.col("toxic") >= 1, TOXIC_ROWS / max(toxic, 1)).otherwise(CLEAN_ROWS / max(clean, 1))
    chosen = marks.where(F.col("u") < share).limit(2 * (TOXIC_ROWS + CLEAN_ROWS))
    rows = docs.where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("doc_id", (F.col("toxic") >= 1).cast("int").alias("toxic"), "text")
    rows = docs.where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    rows = materialise(rows.select("doc_id", F.when(F.col("toxic") >= 1, 1).otherwise(0).alias("toxic"), "u", F.length("text").alias("n"), "text"), "sample")
    kept, text = F.lit(False), F.col("text")
    for kind, bound in ((1, 6 * SAMPLE_WORDS * TOXIC_ROWS // (TOXIC_ROWS + CLEAN_ROWS)), (0, 6 * SAMPLE_WORDS * CLEAN_ROWS // (TOXIC_ROWS + CLEAN_ROWS))):
        mine = rows.where(F.col("toxic") == kind)
        if (mine.agg(F.sum("n")).first()[0] or 0) <= bound:
            kept = kept | (F.col("toxic") == kind)
            continue
        longest, last, taken = max(bound // LEAST_TEXTS, 1), -1.0, 0
        for r in mine.groupBy("u").agg(F.sum(F.least("n", F.lit(longest))).alias("n")).orderBy("u").toLocalIterator():
            taken += r["n"]
            if taken > bound and last >= 0:
                break
            last = r["u"]
        kept = kept | ((F.col("toxic") == kind) & (F.col("u") <= last))
        text = F.when((F.col("toxic") == kind) & (F.col("n") > longest), spread(longest)).otherwise(text)
    found = sorted((r["doc_id"], r["toxic"], r["text"]) for r in rows.where(kept).select("doc_id", "toxic", text.alias("text")).toLocalIterator())
    return [t for _, _, t in found], [y for _, y, _ in found]


def spread(size: int) -> Column:
    """About ``size`` characters of a longer ``text`` of length ``n``: spans of equal distance from its start to its end."""
    span = max(min(SPAN, size // 8), 1)
    spans = max(size // (span + 1), 1)
    step = (F.col("n") - span) / max(spans - 1, 1)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(spans - 1)), lambda k: F.col("text").substr(F.floor(k * step).cast("int") + 1, F.lit(span))), " ")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1) and predicted (score >= 0.7).

    Learns from labelled rows that aren't held out. Null and empty texts get the score of a text with nothing toxic in
    it. Without labels, or with labels of one class, all texts score alike. Repeated rows are scored each; no rows give none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    net = docs.sparkSession.sparkContext.broadcast(fit(*sample(rows, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillon.llm.langid import portions

        scorer = Scorer(net.value)
        for batch in batches:
            for part in portions(batch, 2):
                s = scorer.scores(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array((s >= CUTOFF).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCHEMA)
