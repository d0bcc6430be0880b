"""BPE encoding and decoding with word ends, by batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. A round looks up all neighbouring pairs by binary search among
the sorted keys of the merges, finds the lowest rank of each word and merges every place of that pair; words without a
pair that can be merged leave the array.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliflow.llm.common import id_or_marker, id_or_null, small_batches

#: White space as Unicode has it, which str.split() knows as well, besides four control characters.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
_CONTROL = regex.compile(r"[\x1c-\x1f]")
_SPACES = regex.compile(f"[{_SPACE}]+")
#: Words that are kept encoded between batches, and characters of text that one round of merges takes at most (or one text).
KEPT_WORDS = 150_000
BATCH_CHARS = 2_000_000
_NONE = np.iinfo(np.int32).max


class WordBpe:
    """Encoder and decoder for a tokenizer file whose words end in a suffix and are read in lower case."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        self._names = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self._split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        self._inner = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self._final = np.array([vocab[char[b] + suffix] for b in range(256)], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._base = len(self._names)
        keys = np.array([vocab[a] * self._base + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int32)
        self._made = np.array([vocab[a + b] for a, b in merges], np.int32)
        made_at: dict[str, int] = {}
        for rank, (a, b) in enumerate(merges):
            made_at.setdefault(a + b, rank)
        #: A pair may be merged at all its places at once if nothing it makes can be merged earlier than itself.
        self._all_at_once = all(max(made_at.get(a, -1), made_at.get(b, -1)) < rank for rank, (a, b) in enumerate(merges)) and len(made_at) == len(merges)
        self._kept: dict[str, tuple[int, ...]] = {}

    def _merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self._inner[raw]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self._final[raw[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        while len(symbols):
            pair = np.full(len(symbols), _NONE, np.int32)
            inside = np.flatnonzero(owner[:-1] == owner[1:])
            key = symbols[inside].astype(np.int64) * self._base + symbols[inside + 1]
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            known = self._keys[at] == key
            pair[inside[known]] = self._ranks[at[known]]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(pair, starts)
            count = np.diff(np.r_[starts, len(symbols)])
            done = lowest == _NONE
            for s, n in zip(starts[done].tolist(), count[done].tolist()):
                out[owner[s]] = symbols[s : s + n]
            each = np.repeat(lowest, count)
            merge = (pair == each) & (pair != _NONE)
            if self._all_at_once:  # of places that overlap, every second one from the left
                hit = np.flatnonzero(merge)
                fresh = np.r_[True, (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]])] if len(hit) else np.zeros(0, bool)
                run = np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0)) if len(hit) else hit
                hit = hit[run % 2 == 0]
            else:
                hit = np.flatnonzero(merge)
                hit = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]] if len(hit) else hit
            symbols[hit] = self._made[pair[hit]]
            keep = ~np.repeat(done, count)
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def _chunks(self, text: str) -> list[str]:
        """Runs without white space, normalised."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [x for x in _SPACES.split(text) if x] if _CONTROL.search(text) else text.split()

    def _learn(self, chunks: set[str]) -> None:
        """Encode the chunks that aren't kept yet."""
        if len(self._kept) > KEPT_WORDS:
            self._kept.clear()
        new = [c for c in chunks if c not in self._kept]
        if not new:
            return
        pieces = [[p.encode("utf-8", "surrogatepass") for p in _PIECES.findall(c)] for c in new]
        distinct = list(dict.fromkeys(chain.from_iterable(pieces)))
        ids = {p: tuple(x.tolist()) for p, x in zip(distinct, self._merge(distinct))} if distinct else {}
        for c, ps in zip(new, pieces):
            self._kept[c] = ids[ps[0]] if len(ps) == 1 else tuple(chain.from_iterable(ids[p] for p in ps))

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text, in order; null is empty. Special tokens that stand in a text are taken as such."""
        at = 0
        while at < len(texts):
            upto, chars = at, 0
            while upto < len(texts) and (upto == at or chars + len(texts[upto] or "") <= BATCH_CHARS):
                chars += len(texts[upto] or "")
                upto += 1
            parts = []
            for text in texts[at:upto]:
                text = text or ""
                cuts = [(m.start(), m.end()) for m in self._split.finditer(text)] if self._split and "<|" in text else []
                runs, last = [], 0
                for a, b in cuts:
                    runs += [self._chunks(text[last:a]), self.special[text[a:b]]]
                    last = b
                parts.append([*runs, self._chunks(text[last:] if last else text)])
            self._learn({c for p in parts for r in p if isinstance(r, list) for c in r})
            get = self._kept.__getitem__
            for p in parts:
                yield list(chain.from_iterable(chain.from_iterable(map(get, r)) if isinstance(r, list) else (r,) for r in p))
            at = upto

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, joined by blanks; the file has no decoder that would do more."""
        names = self._names
        return " ".join([names[i] for i in ids])


@lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    return WordBpe(path)


def bpe_encode(docs: DataFrame, tokenizer: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text as an array; null and empty texts have none."""

    @F.pandas_udf("array<int>")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(codec(tokenizer).encode(texts.tolist())))

    return docs.withColumn(out_col, ids_of(F.col(text_col)))


def bpe_decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text that each array of ids stands for; null is empty."""

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series([codec(tokenizer).decode([] if x is None else list(x)) for x in ids], dtype=object)

    return rows.withColumn(out_col, text_of(F.col(ids_col)))


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def op4_query(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each input row with digests of its ids and of their decoding; ids don't leave the worker."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(tokenizer)
        numbers = [str(i) for i in range(len(bpe._names))]
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], bpe.encode(batch["text"].tolist())):
                decimal = " ".join([numbers[i] for i in ids])
                rows.append((doc_id, len(ids), sha256(decimal.encode()).hexdigest(), sha256(bpe.decode(ids).encode("utf-8")).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_or_marker("doc_id").alias("doc_id"), "text").mapInPandas(run, DIGEST).withColumn("doc_id", id_or_null("doc_id"))
