"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad. Its potential is linear in binned features of the line and of the lines before and
after it, and neighbouring states share a transition table. Forward-backward gives each line's probability of being good;
their mean, weighted by line length, is the document's share of good text, which a logistic scale fitted on the same
documents turns into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampliflow.llm.common import least_hashed, materialize, small_batches

#: Bound on the labelled documents that are learned from; they are those with the least hashes of their ids.
MAX_LABELLED = 6000
#: Bound on the lines that are learned from. A document of more than PART_LINES lines teaches in parts, as chains of their own; parts are
#: taken in the order of their documents' hashes.
MAX_LINES, PART_LINES = 2_000_000, 4096
THRESHOLD = 0.7
_SYMBOLS = "#*$%&<>"
_ENDS = frozenset(".!?:;…\"'”»)")
#: Upper edges of the bins of each feature, which are shares or counts of a line.
_BINS = (
    ("symbols a word", (0.001, 0.1, 0.3, 1.0, 2.0)),
    ("bars a word", (0.001, 0.1, 0.2, 0.4)),
    ("exclamation marks a word", (0.001, 0.1, 0.3, 0.7)),
    ("upper-case words", (0.05, 0.2, 0.5, 0.8)),
    ("distinct words", (0.15, 0.3, 0.5, 0.7, 0.85)),
    ("characters a word", (3.0, 4.0, 5.0, 6.5, 8.0, 11.0)),
    ("words", (2.0, 4.0, 8.0, 16.0, 40.0, 100.0, 400.0)),
    ("ends with a mark", (0.5,)),
    ("digits", (0.001, 0.05, 0.2)),
    ("words equal to the one before", (0.001, 0.05, 0.2, 0.5)),
)
_EDGES = [np.array(e) for _, e in _BINS]
_OFFSETS = np.cumsum([0, *(len(e) + 1 for e in _EDGES)])
WIDTH = int(_OFFSETS[-1])
#: Offset rows of the weights: the line itself, the one before, the one after; the last entry of each is "no line".
PLACES = 3


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bin numbers, a row for each line with a word; lengths of these lines)."""
    raw, lengths = [], []
    for line in (text or "").split("\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        size = len(line)
        symbols = sum(map(line.count, _SYMBOLS))
        digits = 0 if line.isalpha() else sum(map(line.count, "0123456789"))
        same = sum(map(str.__eq__, words, words[1:])) if len(set(words)) < n else 0
        raw.append((symbols / n, line.count("|") / n, line.count("!") / n, sum(map(str.isupper, words)) / n, len(set(words)) / n if n > 3 else 1.0, size / n, n, words[-1][-1] in _ENDS, digits / size, same / n))
        lengths.append(size)
    values = np.array(raw, float).reshape(-1, len(_BINS))
    bins = np.stack([np.searchsorted(e, values[:, k], side="right") + _OFFSETS[k] for k, e in enumerate(_EDGES)], axis=1)
    return bins.astype(np.int16), np.array(lengths, np.int64)


@dataclass
class LineCrf:
    weights: np.ndarray  # PLACES x (WIDTH + 1): what a feature adds to the potential of "good"
    steps: np.ndarray  # 2 x 2: transition potentials, bad first
    scale: tuple[float, float] = (1.0, 0.0)


def _layout(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All lines one after another, with those before and after each (WIDTH in every column where there is none)."""
    lines = np.concatenate(docs).astype(np.int64)
    none = np.full((1, lines.shape[1]), WIDTH)
    before, after = np.concatenate([none, lines[:-1]]), np.concatenate([lines[1:], none])
    ends = np.cumsum([len(d) for d in docs])
    after[ends - 1] = WIDTH
    before[ends[:-1]] = WIDTH
    return lines, before, after


def _marginals(potential: np.ndarray, sizes: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability that a line is good; expected counts of the four transitions), for documents of ``sizes`` >= 1 lines."""
    order = np.argsort(-sizes, kind="stable")
    size, start = sizes[order], (np.cumsum(sizes) - sizes)[order]
    longest, n = int(size[0]), len(size)
    alive = np.searchsorted(-size, -np.arange(longest), side="left")  # documents with more than t lines
    step = np.exp(steps - steps.max())
    local = np.exp(np.stack([-np.logaddexp(0, potential), -np.logaddexp(0, -potential)], axis=1))
    forward, backward = np.empty_like(local), np.empty_like(local)
    a = local[start]
    a = a / a.sum(1, keepdims=True)
    forward[start] = a
    for t in range(1, longest):
        m = alive[t]
        at = start[:m] + t
        a = (a[:m] @ step) * local[at] + 1e-300
        a /= a.sum(1, keepdims=True)
        forward[at] = a
    counts = np.zeros((2, 2))
    b = np.ones((n, 2))
    for t in range(longest - 1, -1, -1):
        m = alive[t]
        at = start[:m] + t
        more = alive[t + 1] if t + 1 < longest else 0
        if more:
            nxt = local[at[:more] + 1] * backward[at[:more] + 1]
            joint = forward[at[:more]][:, :, None] * step * nxt[:, None, :]
            counts += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            back = nxt @ step.T + 1e-300
            b[:more] = back / back.sum(1, keepdims=True)
        backward[at] = b[:m]
    both = forward * backward
    return both[:, 1] / both.sum(1), counts


def _potential(crf: LineCrf, layout: tuple[np.ndarray, ...]) -> np.ndarray:
    return sum(crf.weights[p][x].sum(1) for p, x in enumerate(layout))


def good_share(crf: LineCrf, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Length-weighted mean probability of the lines, 0 for documents without a line."""
    out = np.zeros(len(docs))
    full = [k for k, (x, _) in enumerate(docs) if len(x)]
    if full:
        layout = _layout([docs[k][0] for k in full])
        sizes = np.array([len(docs[k][0]) for k in full])
        good, _ = _marginals(_potential(crf, layout), sizes, crf.steps)
        length = np.concatenate([docs[k][1] for k in full]).astype(float)
        starts = np.cumsum(sizes) - sizes
        out[full] = np.add.reduceat(good * length, starts) / np.add.reduceat(length, starts)
    return out


def score_of(crf: LineCrf, share: np.ndarray) -> np.ndarray:
    a, b = crf.scale
    return 1 / (1 + np.exp(-(a * share + b)))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 120, rate: float = 0.08, ridge: float = 1e-3) -> LineCrf:
    """Gradient ascent (Adam) on the mean log-likelihood of the lines, which bear their document's label.

    Both labels weigh the same in sum. If only one label is known every text gets nearly that; without labels, one half.
    """
    crf = LineCrf(np.zeros((PLACES, WIDTH + 1)), np.zeros((2, 2)))
    keep = [k for k, (x, _) in enumerate(docs) if len(x)]
    labels = np.asarray(labels, float)
    if not keep or len({labels[k] for k in keep}) < 2:
        return LineCrf(crf.weights, crf.steps, (0.0, 3.0 * float(np.sign(2 * labels - 1).mean()) if len(labels) else 0.0))
    feats, y = [docs[k][0] for k in keep], labels[keep]
    parts = [(_layout([feats[k] for k in group]), np.array([len(feats[k]) for k in group]), group) for group in (np.flatnonzero(y == v) for v in (0.0, 1.0))]
    moments = [np.zeros((2, *w.shape)) for w in (crf.weights, crf.steps)]
    for t in range(1, rounds + 1):
        up_w, up_s = np.zeros_like(crf.weights), np.zeros_like(crf.steps)
        for value, (layout, sizes, _) in enumerate(parts):
            good, counts = _marginals(_potential(crf, layout), sizes, crf.steps)
            total = len(good)
            miss = (value - good) / total
            for p, x in enumerate(layout):
                up_w[p] += np.bincount(x.ravel(), np.repeat(miss, x.shape[1]), WIDTH + 1)
            seen = np.zeros((2, 2))
            seen[value, value] = total - len(sizes)
            up_s += (seen - counts) / total
        for k, (w, g) in enumerate(((crf.weights, up_w), (crf.steps, up_s))):
            g = g - ridge * w
            moments[k][0] += 0.1 * (g - moments[k][0])
            moments[k][1] += 0.01 * (g * g - moments[k][1])
            w += rate * (moments[k][0] / (1 - 0.9**t)) / (np.sqrt(moments[k][1] / (1 - 0.99**t)) + 1e-8)
    share = good_share(crf, [docs[k] for k in keep])
    a, b = 4.0, -2.0
    for _ in range(200):  # Newton steps for the logistic scale, slightly damped
        p = 1 / (1 + np.exp(-(a * share + b)))
        w = p * (1 - p) + 1e-6
        g = np.array([((y - p) * share).sum() - 1e-2 * a, (y - p).sum()])
        h = np.array([[(w * share * share).sum() + 1e-2, (w * share).sum()], [(w * share).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = float(np.clip(a + 0.5 * da, 0.1, 60)), float(np.clip(b + 0.5 * db, -60, 60))
    crf.scale = (a, b)
    return crf


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_lines: int = MAX_LINES, part_lines: int = PART_LINES) -> LineCrf:
    """Fit on at most ``max_labelled`` labelled documents that aren't held out, of any length, and at most ``max_lines`` of their lines; only the bins of these reach the driver."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label")).where("_id IS NOT NULL AND _label IS NOT NULL")
    known = known.where(~held_out("_id")).groupBy("_id").agg(F.min("_label").alias("_label"))
    known = least_hashed(known, "_id", max_labelled)
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(known), "_id")
    # Rows that share an id teach once, by their least text.
    rows = rows.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, label, text in zip(batch["_id"], batch["_label"], batch["_text"]):
                x, n = line_features(text)
                at = range(0, max(len(n), 1), part_lines)
                yield pd.DataFrame({"id": doc, "label": label, "part": range(len(at)), "n": [len(n[a : a + part_lines]) for a in at], "bins": [x[a : a + part_lines].tobytes() for a in at], "lengths": [n[a : a + part_lines].tobytes() for a in at]})

    parts = materialize(rows.mapInPandas(bins, "id long, label int, part int, n int, bins binary, lengths binary"), "op5-bins")
    order = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("id"), "id", "part").rowsBetween(Window.unboundedPreceding, 0)  # a row for each part
    wanted = parts.select("id", "part", F.sum("n").over(order).alias("so_far")).where(F.col("so_far") <= max_lines).select("id", "part")
    got = parts.join(F.broadcast(wanted), ["id", "part"]).toPandas().sort_values(["id", "part"])
    sample = [(np.frombuffer(x, np.int16).reshape(-1, len(_BINS)), np.frombuffer(n, np.int64)) for x, n in zip(got["bins"], got["lengths"])]
    return fit(sample, got["label"].to_numpy())


def score(docs: DataFrame, crf: LineCrf, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score of each text (0 to 1); an existing column of that name is replaced."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values, some, chars = [], [], 0
            for text in texts:
                some.append(line_features(text))
                chars += len(text or "")
                if chars > 4_000_000:
                    values.append(score_of(crf, good_share(crf, some)))
                    some, chars = [], 0
            if some:
                values.append(score_of(crf, good_share(crf, some)))
            yield pd.Series(np.concatenate(values) if values else np.zeros(0))

    return docs.withColumn(out_col, scored(F.col(text_col)))


def op5_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each input row; null and empty texts have no good line.

    Rows without an id aren't held out and have no label. Repeated rows, and different texts of one id, are scored one by one.
    Without labels all scores are 0.5. Other columns than doc_id and text are not read.
    """
    crf = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), crf)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
