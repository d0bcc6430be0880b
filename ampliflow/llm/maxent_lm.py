"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | h) * P(group | class, h) * P(member | group, h) * P(word | member).

There are 32 classes of 32 groups of 32 members. A frequent word is a member of its own, other words share the members of
their endings, so nearly all of a word's probability depends on the history. Each of the first three factors is a
softmax over hashed n-gram and skip features: the words one and two back, their pairs with classes, and the classes up
to four back. Its weights are trained by gradient updates: each trainer runs over its share of the training documents from
the current weights, and the next state is the mean of their changes, row by row, weighed by the gradients that a row saw.
P(word | member) is the relative frequency within the member. All positions of all training documents train, once each.

Texts are tokenised once, into blocks of word numbers with a dictionary each. Counts of all words come from a shuffle of
the dictionaries; blocks meet the counts of their words again when they are scored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampliflow.llm.common import id_or_marker, id_or_null, materialize, small_batches

WIDTH = 32
MEMBERS = WIDTH**3
#: Members for the most frequent words and for the most frequent endings of other words; the rest is for other endings by a hash.
FREQUENT, ENDINGS = 24 * 1024, 7 * 1024
#: Neighbours by which members are compared: so many frequent words and one for all others, on both sides.
LANDMARKS = 31
#: Hashed features of the class, the group and the member.
FEATURES = (4, 2, 1)
#: Classes this far back are seen.
BACK = 4
#: Rows of a feature: a row for each so many characters of training text, in powers of two between these bounds.
ROW_CHARS, LEAST_BITS, MOST_BITS = 16384, 14, 15
ROUNDS = 2
#: A round has a trainer for each so many characters of its texts, and this many at least; changes are averaged by groups of at most FAN trainers.
TRAINER_CHARS, TRAINERS = 48_000_000, 8
FAN = 256
#: Positions of an update: a part of those already seen, between these bounds.
LEAST_BATCH, MOST_BATCH, BATCH_PART = 512, 2048, 8
#: Steps are RATE over the root of a row's squared gradients, which start from FIRST.
RATE, FIRST = 0.8, 0.5
#: Characters of text in a block.
BLOCK_CHARS = 8_000_000
#: Weight rows that travel together.
SHARD = 4096
END = b""
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = np.random.default_rng(2024).integers(0, 1 << 32, (16, WIDTH * WIDTH), np.uint32)
_ONES = np.ones(WIDTH, np.float32)


def tokens(text: str | None) -> list[bytes]:
    """Lower-case (A-Z) words, then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    words.append(END)
    return words


def ending(word: bytes) -> int:
    """The last three bytes before punctuation, as a number."""
    return int.from_bytes(word.rstrip(b".,;:!?\"')|")[-3:], "big")


def word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


# Blocks of tokenised texts.

BLOCKS = "block long, chars long, doc binary, out binary, size binary, ids binary, word binary, ending binary, n binary"


def _tokenised(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each block: documents with their lengths, numbers of all words, and for each number the word's hash, ending and count in training texts."""
    context = TaskContext.get()
    base, made = (context.partitionId() if context else 0) << 32, 0
    docs: list[tuple[int, bool, np.ndarray]] = []
    number: dict[bytes, int] = defaultdict(count().__next__)
    chars = 0

    def block() -> pd.DataFrame:
        ids = np.concatenate([x for *_, x in docs])
        out, size = np.array([o for _, o, _ in docs]), np.array([len(x) for *_, x in docs])
        n = np.bincount(ids[np.repeat(~out, size)], minlength=len(number))
        row = {"doc": np.array([d for d, *_ in docs], np.int64), "out": out, "size": size.astype(np.int64), "ids": ids}
        row |= {"word": np.fromiter(map(word_hash, number), np.int64, len(number)), "ending": np.fromiter(map(ending, number), np.int32, len(number)), "n": n.astype(np.int32)}
        return pd.DataFrame({"block": [base + made], "chars": [chars]} | {k: [v.tobytes()] for k, v in row.items()})

    for frame in frames:
        for doc, out, text in zip(frame["doc"], frame["out"], frame["text"]):
            words = tokens(text)
            docs.append((doc, bool(out), np.fromiter(map(number.__getitem__, words), np.int32, len(words))))
            chars += len(text or "")
            if chars >= BLOCK_CHARS:
                yield block()
                docs, number, chars, made = [], defaultdict(count().__next__), 0, made + 1
    if docs:
        yield block()


def tokenise(docs: DataFrame) -> DataFrame:
    """Blocks of all rows of ``docs`` (doc_id, text), written to the shared folder; null texts are empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(id_or_marker("doc_id").alias("doc"), held_out().alias("out"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(rows.mapInPandas(_tokenised, BLOCKS), "op3-blocks")


def _numbers(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(blob, kind)


def _entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for block, word, end, n in zip(frame["block"], frame["word"], frame["ending"], frame["n"]):
            word = _numbers(word, np.int64)
            yield pd.DataFrame({"block": block, "at": np.arange(len(word), dtype=np.int32), "word": word, "ending": _numbers(end, np.int32), "n": _numbers(n, np.int32)})


def count_words(blocks: DataFrame) -> DataFrame:
    """(block, at, c, first, word, ending): for each word of each block its count in all training texts; ``first`` marks one row of each word, which has its hash and ending."""
    entries = blocks.select("block", "word", "ending", "n").mapInPandas(_entries, "block long, at int, word long, ending int, n int")
    same = Window.partitionBy("word")
    found = entries.withColumns({"c": F.sum("n").over(same), "first": F.col("block") == F.min("block").over(same)})
    return materialize(found.select("block", "at", "c", "first", *[F.when(F.col("first"), F.col(k)).alias(k) for k in ("word", "ending")]), "op3-words")


# Classes.


@dataclass
class Members:
    """The member of a word by its hash, or else by its ending."""

    words: np.ndarray
    of_word: np.ndarray
    endings: np.ndarray
    of_ending: np.ndarray
    spare: np.ndarray

    def of(self, word: np.ndarray, end: np.ndarray) -> np.ndarray:
        found = self.spare[end % len(self.spare)]
        for keys, values, asked in ((self.endings, self.of_ending, end), (self.words, self.of_word, word)):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                found = np.where(keys[at] == asked, values[at], found)
        return found

    def arranged(self, place: np.ndarray) -> Members:
        return Members(self.words, place[self.of_word], self.endings, place[self.of_ending], place[self.spare])


def frequent_members(counted: DataFrame) -> tuple[Members, np.ndarray]:
    """Members in order of frequency, and the hashes of the most frequent words."""
    known = counted.where("first AND c > 0").select("word", "ending", "c")
    top = known.orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    rest = known
    if top:
        last = top[-1]
        rest = known.where((F.col("c") < last["c"]) | ((F.col("c") == last["c"]) & (F.col("word") > last["word"])))
    ends = [r["ending"] for r in rest.groupBy("ending").agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "ending").limit(ENDINGS).collect()]
    words = np.array([r["word"] for r in top], np.int64)
    ends = np.array(ends, np.int32)
    by_word, by_end = np.argsort(words), np.argsort(ends)
    members = Members(words[by_word], by_word, ends[by_end], FREQUENT + by_end, np.arange(FREQUENT + ENDINGS, MEMBERS))
    return members, words[:LANDMARKS]


def member_counts(counted: DataFrame, members: Members) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct training words of each member."""

    def of_members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            m = members.of(frame["word"].to_numpy(), frame["ending"].to_numpy())
            yield pd.DataFrame({"m": m.astype(np.int32), "n": frame["c"].to_numpy()})

    n, v = np.zeros(MEMBERS, np.int64), np.zeros(MEMBERS, np.int64)
    words = counted.where("first AND c > 0").select("word", "ending", "c").mapInPandas(of_members, "m int, n long")
    for r in words.groupBy("m").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # at most MEMBERS rows
        n[r["m"]], v[r["m"]] = r["n"], r["v"]
    return n, v


@dataclass
class Text:
    """Training or all documents of a block: word numbers with their places in the documents, and the dictionary."""

    ids: np.ndarray
    place: np.ndarray
    size: np.ndarray
    word: np.ndarray
    member: np.ndarray


def places(size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _text(row, members: Members, chosen=None) -> Text:
    """``chosen`` tells which documents by (doc, size, out)."""
    ids, size = _numbers(row.ids, np.int32), _numbers(row.size_, np.int64)
    word = _numbers(row.word, np.int64)
    if chosen is not None:
        mine = chosen(_numbers(row.doc, np.int64), size, _numbers(row.out, bool))
        ids, size = ids[np.repeat(mine, size)], size[mine]
    return Text(ids, places(size), size, word, members.of(word, _numbers(row.ending, np.int32)).astype(np.int32))


def _rows(frames: Iterator[pd.DataFrame]):
    for frame in frames:
        yield from frame.rename(columns={"size": "size_"}).itertuples(index=False)


def _training(doc, size, out):
    return ~out


def neighbours(blocks: DataFrame, members: Members, landmarks: np.ndarray) -> np.ndarray:
    """How often each member has each landmark (or another word) among the two words before it and the two after it."""
    side = len(landmarks) + 1
    order = np.argsort(landmarks)
    known = landmarks[order]

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(MEMBERS * 2 * side, np.int64)
        for row in _rows(frames):
            text = _text(row, members, _training)
            at = np.minimum(np.searchsorted(known, text.word), len(known) - 1)
            near = np.where(known[at] == text.word, order[at], side - 1)[text.ids]
            m = text.member[text.ids].astype(np.int64)
            for k in (1, 2):
                ok = text.place[k:] >= k
                for a, b, shift in ((m[k:], near[:-k], 0), (m[:-k], near[k:], side)):
                    sums += np.bincount((a * (2 * side) + b + shift)[ok], minlength=len(sums))
        key = np.flatnonzero(sums)
        if len(key):
            yield pd.DataFrame({"key": key.astype(np.int32), "n": sums[key]})

    table = np.zeros(MEMBERS * 2 * side)
    if len(landmarks):
        columns = blocks.select("doc", "out", "size", "ids", "word", "ending")
        found = columns.mapInPandas(counted, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # two million rows at most
        table[found["key"].to_numpy()] = found["n"].to_numpy()
    return table.reshape(MEMBERS, 2 * side)


def arrangement(profile: np.ndarray) -> np.ndarray:
    """New numbers of the members, so that those of a class, and within it of a group, have like neighbours: halves along the direction of most variance, ten times."""
    weight = profile.sum(axis=1)
    points = np.sqrt(profile / np.maximum(weight, 1)[:, None])
    cells = [np.arange(len(points))]
    while len(cells) < WIDTH * WIDTH:
        halves = []
        for cell in cells:
            w = weight[cell] + 1e-3
            x = points[cell] - np.average(points[cell], axis=0, weights=w)
            _, directions = np.linalg.eigh((x * w[:, None]).T @ x)
            order = cell[np.argsort(x @ directions[:, -1], kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        cells = halves
    place = np.empty(len(points), np.int64)
    place[np.concatenate(cells)] = np.arange(len(points))
    return place


# Features and factors.


def _back(x: np.ndarray, place: np.ndarray, k: int, nothing: int) -> np.ndarray:
    out = np.full(len(x), nothing, x.dtype)
    if k < len(x):
        out[k:] = np.where(place[k:] >= k, x[:-k], x.dtype.type(nothing))
    return out


def n_rows(bits: int) -> int:
    return sum(FEATURES) << bits


def feature_rows(ids: np.ndarray, place: np.ndarray, text: Text, bits: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For class, group and member: rows of the weights by feature and position, the context of the bias, and the target."""
    h = (text.word.view(np.uint64) >> np.uint64(32)).astype(np.uint32)[ids]
    m = text.member[ids]
    group, cls = m >> 5, m >> 10
    h1, h2 = (_back(h, place, k, 0) for k in (1, 2))
    c = [None, *(_back(cls, place, k, WIDTH - 1) for k in range(1, BACK + 1))]
    mix = lambda k, x: _MIX[k][x]
    features = (
        (h1, h1 ^ mix(0, c[2]), h2, mix(1, c[3]) ^ mix(2, c[4])),
        (h1 ^ mix(3, cls), mix(6, c[1]) ^ mix(7, c[2]) ^ mix(8, cls)),
        (h1 ^ mix(9, group),),
    )
    rows, shift, base = [], np.uint32(32 - bits), 0
    for some in features:
        level = np.empty((len(some), len(ids)), np.int32)
        for k, x in enumerate(some):
            np.add((x >> shift).astype(np.int32), base, out=level[k])
            base += 1 << bits
        rows.append(level)
    return rows, [np.zeros(len(ids), np.int32), cls, group], [cls, group & (WIDTH - 1), m & (WIDTH - 1)]


def biases(n: np.ndarray) -> list[np.ndarray]:
    """Log shares of the classes, of the groups in each class and of the members in each group."""
    out = []
    for x in (n.reshape(1, WIDTH, -1).sum(axis=2), n.reshape(WIDTH, WIDTH, -1).sum(axis=2), n.reshape(-1, WIDTH)):
        x = x + 1 / WIDTH
        out.append(np.log(x / x.sum(axis=1, keepdims=True)).astype(np.float32))
    return out


def softmax(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Probabilities by position; the exponents are kept below 60, so that no sum overflows."""
    x = np.take(bias, context, axis=0)
    one = np.empty_like(x)
    for r in rows:
        x += np.take(weights, r, axis=0, out=one, mode="clip")
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x *= (1 / (x @ _ONES))[:, None]
    return x


def row_sums(g: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sums of ``g`` over the positions that name each).

    ``rows`` has a line for each feature, with no row in two lines. Most rows have one position; rows of many positions are
    summed by a product with 0 and 1.
    """
    n = len(g)
    key = rows.astype(np.int64) << 32
    key |= np.arange(n)
    key = np.sort(key.ravel())
    row, at = key >> 32, key & 0xFFFFFFFF
    head = np.r_[0, np.flatnonzero(row[1:] != row[:-1]) + 1]
    times = np.diff(head, append=len(key))
    single, more = head[times == 1], np.flatnonzero(times > 1)
    more = more[np.argsort(-times[more], kind="stable")]
    first, times = head[more], times[more]
    total = np.empty((len(head), g.shape[1]), g.dtype)
    np.take(g, at[single], axis=0, out=total[: len(single)], mode="clip")
    sums = total[len(single) :]
    many = int((times >= 8).sum())
    np.take(g, at[first[many:]], axis=0, out=sums[many:], mode="clip")
    for k in range(1, 7):
        to = int((times > k).sum())
        if to == many:
            break
        sums[many:to] += np.take(g, at[first[many:to] + k], axis=0, mode="clip")
    for a in range(0, many, 256):
        part = range(a, min(a + 256, many))
        table = np.zeros((len(part), n), g.dtype)
        for k in part:
            table[k - a, at[first[k] : first[k] + times[k]]] = 1
        sums[a : a + len(part)] = table @ g
    return row[np.r_[single, first]], total


def update(weights: np.ndarray, seen: np.ndarray, text: Text, bias: list[np.ndarray], bits: int, done: int = 0) -> None:
    """Gradient updates at every position, in place, after ``done`` positions; ``seen`` sums the squared gradients of each row and sets its step."""
    whole = weights.view(f"V{weights.itemsize * WIDTH}").ravel()  # rows are written as single values
    for a in range(0, len(text.ids), 128 * 1024):
        from_ = max(0, a - BACK)
        rows, context, target = feature_rows(text.ids[from_ : a + 128 * 1024], text.place[from_ : a + 128 * 1024], text, bits)
        b, end = a - from_, len(context[0])
        while b < end:
            now = slice(b, b + min(MOST_BATCH, max(LEAST_BATCH, done // BATCH_PART)))
            for r, c, t, own in zip(rows, context, target, bias):
                r, t = r[:, now], t[now]
                g = softmax(weights, r, own, c[now])
                np.negative(g, out=g)
                g[np.arange(len(t)), t] += 1
                used, total = row_sums(g, r)
                slope = seen[used] + np.einsum("ij,ij->i", total, total)
                seen[used] = slope
                total *= (RATE / np.sqrt(slope))[:, None]
                total += np.take(weights, used, axis=0, mode="clip")
                whole[used] = total.view(whole.dtype).ravel()
            done += min(now.stop, end) - b
            b = now.stop


# Training.

CHANGES = "shard int, positions long, row binary, energy binary, scale binary, change binary"


def _packed(row: np.ndarray, energy: np.ndarray, change: np.ndarray) -> dict[str, list[bytes]]:
    """Changes of some rows, in 127 steps up to the largest of a row."""
    scale = (np.abs(change).max(axis=1) / 127).astype(np.float32)
    steps = np.rint(change / np.maximum(scale, 1e-30)[:, None]).astype(np.int8)
    return {"row": [row.astype(np.int16).tobytes()], "energy": [energy.astype(np.float32).tobytes()], "scale": [scale.tobytes()], "change": [steps.tobytes()]}


def _unpacked(row: bytes, energy: bytes, scale: bytes, change: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _numbers(row, np.int16).astype(np.int64), _numbers(energy, np.float32), _numbers(change, np.int8).reshape(-1, WIDTH) * _numbers(scale, np.float32)[:, None]


@dataclass
class MaxentLm:
    members: Members
    n: np.ndarray
    v: np.ndarray
    bias: list[np.ndarray]
    bits: int
    weights: np.ndarray
    seen: np.ndarray


def turn_of(doc: np.ndarray, size: np.ndarray, rounds: int) -> np.ndarray:
    """The round in which a document trains; documents of one id (or none) are told apart by their lengths."""
    x = (doc.view(np.uint64) + size.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD)
    return ((x >> np.uint64(40)) % np.uint64(rounds)).astype(np.int64)


def _trainer(members: Members, bias: list[np.ndarray], bits: int, state, turn: int, rounds: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, before = state.value
        w, seen, worked = start.copy(), before.copy(), 0
        for row in _rows(frames):
            text = _text(row, members, lambda doc, size, out: ~out & (turn_of(doc, size, rounds) == turn))
            if len(text.ids):
                update(w, seen, text, bias, bits, worked)
                worked += len(text.ids)
        for s in range(0, len(w), SHARD) if worked else ():
            energy = seen[s : s + SHARD] - before[s : s + SHARD]
            row = np.flatnonzero(energy > 0)
            if len(row):
                yield pd.DataFrame({"shard": [s // SHARD], "positions": [worked]} | _packed(row, energy[row], w[s + row] - start[s + row]))

    return run


def mean_changes(changes: DataFrame, trainers: int, fan: int = FAN) -> DataFrame:
    """Of each shard: the mean change of each row over the trainers that saw it, by the energy of their gradients, and the sum of these.

    Rows have ``trainer`` (from 0) and what ``CHANGES`` says. At most about ``fan`` of them meet in a task: means of groups are
    averaged again until one group is left.
    """

    def mean(frame: pd.DataFrame) -> pd.DataFrame:
        total, share = np.zeros((SHARD, WIDTH), np.float32), np.zeros(SHARD, np.float32)
        for packed in zip(frame["row"], frame["energy"], frame["scale"], frame["change"]):
            row, energy, change = _unpacked(*packed)
            total[row] += energy[:, None] * change
            share[row] += energy
        row = np.flatnonzero(share)
        found = {"trainer": [frame["trainer"].iloc[0]], "shard": [frame["shard"].iloc[0]], "positions": [frame["positions"].sum()]}
        return pd.DataFrame(found | _packed(row, share[row], total[row] / share[row, None]))

    while True:
        trainers = -(-trainers // fan)
        changes = changes.withColumn("trainer", F.col("trainer") % trainers).groupBy("shard", "trainer").applyInPandas(mean, f"trainer int, {CHANGES}")
        if trainers == 1:
            return changes.drop("trainer")


def train(blocks: DataFrame, counted: DataFrame, rounds: int = ROUNDS, trainer_chars: int = TRAINER_CHARS) -> MaxentLm:
    """Fit on all training documents of the blocks; about a third of them in each of three rounds."""
    context = blocks.sparkSession.sparkContext
    chars = blocks.agg(F.sum("chars")).first()[0] or 0
    members, landmarks = frequent_members(counted)
    members = members.arranged(arrangement(neighbours(blocks, members, landmarks)))
    n, v = member_counts(counted, members)
    bias = biases(n)
    bits = min(MOST_BITS, max(LEAST_BITS, (chars // ROW_CHARS).bit_length() - 1))
    trainers = max(TRAINERS, chars // rounds // trainer_chars + 1)
    weights, seen = np.zeros((n_rows(bits), WIDTH), np.float32), np.full(n_rows(bits), FIRST, np.float32)
    for k in range(rounds):
        state = context.broadcast((weights, seen))  # at most n_rows(MOST_BITS) rows
        columns = blocks.select("doc", "out", "size", "ids", "word", "ending").coalesce(trainers)
        changes = columns.mapInPandas(_trainer(members, bias, bits, state, k, rounds), CHANGES)
        got = mean_changes(changes.withColumn("trainer", F.spark_partition_id()), trainers).collect()  # the weights, whose size is bounded
        weights, seen = weights.copy(), seen.copy()
        for r in got:
            row, energy, change = _unpacked(r["row"], r["energy"], r["scale"], r["change"])
            weights[r["shard"] * SHARD + row] += change
            seen[r["shard"] * SHARD + row] += energy
        state.destroy()
    return MaxentLm(members, n, v, bias, bits, weights, seen)


# Scores.


def log_factors(text: Text, weights: np.ndarray, bias: list[np.ndarray], bits: int) -> np.ndarray:
    """Log10 of the three factors that depend on the history, at each position."""
    total = np.zeros(len(text.ids))
    for a in range(0, len(text.ids), 128 * 1024):
        from_ = max(0, a - BACK)
        rows, context, target = feature_rows(text.ids[from_ : a + 128 * 1024], text.place[from_ : a + 128 * 1024], text, bits)
        for b in range(a - from_, len(context[0]), 8192):
            for r, c, t, own in zip(rows, context, target, bias):
                t = t[b : b + 8192]
                p = softmax(weights, r[:, b : b + 8192], own, c[b : b + 8192])
                total[from_ + b : from_ + b + len(t)] += np.log10(p[np.arange(len(t)), t])
    return total


def score(blocks: DataFrame, counted: DataFrame, model: MaxentLm) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document.

    The factors that depend on the history are scored where the blocks are; then blocks meet the counts of their words.
    """
    members, bias, bits = model.members, model.bias, model.bits
    train_tokens = int(model.n.sum())
    base_norm = float(np.log10(model.n.sum() + 0.5 * (model.v.sum() + 1)))
    member_norm = np.log10(model.n + 0.5 * (model.v + 1))
    state = blocks.sparkSession.sparkContext.broadcast(model.weights)  # at most n_rows(MOST_BITS) rows

    def factors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(frames):
            text = _text(row, members)
            own = np.add.reduceat(log_factors(text, state.value, bias, bits), np.cumsum(text.size) - text.size)
            yield pd.DataFrame({"block": [row.block], "doc": [row.doc], "out": [row.out], "size": [row.size_], "ids": [row.ids], "member": [text.member.astype(np.uint16).tobytes()], "factor": [own.tobytes()]})

    def scored(key, own: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros(len(counts), np.int64)
        c[counts["at"].to_numpy()] = counts["c"].to_numpy()
        log_c = np.log10(c + 0.5)
        row = own.iloc[0]
        ids, size = _numbers(row["ids"], np.int32), _numbers(row["size"], np.int64)
        total = lambda x: np.add.reduceat(x[ids], np.cumsum(size) - size)
        return pd.DataFrame({
            "doc": _numbers(row["doc"], np.int64), "held_out": _numbers(row["out"], bool), "n_tokens": size, "n_known": total((c > 0).astype(np.int64)),
            "base_score": total(log_c - base_norm), "score": total(log_c - member_norm[_numbers(row["member"], np.uint16)]) + _numbers(row["factor"], np.float64),
        })

    columns = blocks.select("block", "doc", "out", "size", "ids", "word", "ending")
    done = columns.mapInPandas(factors, "block long, doc binary, out binary, size binary, ids binary, member binary, factor binary")
    done = done.groupBy("block").cogroup(counted.select("block", "at", "c").groupBy("block")).applyInPandas(scored, "doc long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select(id_or_null("doc").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_query(docs: DataFrame) -> DataFrame:
    """A row for each input row, repeated rows included; other columns than doc_id and text are not read.

    Null and empty texts have the end only. Rows without an id train. Where nothing trains, all words are unknown. Texts are
    never cut; a very long one makes a block of its own.
    """
    blocks = tokenise(docs.select("doc_id", "text"))
    counted = count_words(blocks)
    return score(blocks, counted, train(blocks, counted))
