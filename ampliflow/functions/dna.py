"""DNA functions as Column expressions, and Arrow kernels for what SQL expresses slowly.

Alphabet: ``ACGTU`` and the eleven IUPAC ambiguity codes, upper case.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice, product

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

#: Fixed values of the IUPAC nucleotide code.
PLAIN = "ACGTU"
IUPAC = {"R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
SYMBOLS = PLAIN + "".join(IUPAC)
COMPLEMENT = ("ACGTYRSWMKBDHVN", "TGCARYSWKMVHDBN")
_BIT = {"A": 1, "C": 2, "G": 4, "T": 8}


class InvalidDna(ValueError):
    """A symbol outside the alphabet."""


class InvalidKmerLength(ValueError):
    """A k-mer length that is not positive, or above that of the database."""


class InvalidDimensions(ValueError):
    """Sequences or matrices whose sizes don't agree."""


@contextmanager
def typed_errors() -> Iterator[None]:
    """Inside, a task that fails on an invalid symbol raises ``InvalidDna`` here, with the beginning of the sequence."""
    try:
        yield
    except (PySparkException, Py4JJavaError) as e:
        found = re.search(r"invalid DNA: ([^\n]*)", str(e))
        if found is None:
            raise
        raise InvalidDna(f"invalid DNA: {found[1][:60].strip()}") from e


def checked_primer(p: str) -> str:
    """The primer itself if it is a string of at least one base or code."""
    if not isinstance(p, str):
        raise TypeError(f"expected str, found {type(p).__name__}")
    if not p or set(p) - set(COMPLEMENT[0]):
        raise InvalidDna(f"invalid DNA: {p!r}")
    return p


def rejected(df: DataFrame, *columns: str) -> DataFrame:
    """A row for each sequence of ``df`` with a symbol outside the alphabet: its other columns, and column, place (from 0), symbol and reason.

    A null sequence is rejected too, with a null place.
    """
    others = [c for c in df.columns if c not in columns]
    found = [F.struct(F.lit(c).alias("column"), F.col(c).alias("s"), is_valid(F.col(c)).alias("ok")) for c in columns]
    bad = df.select(*others, F.explode(F.array(*found)).alias("r")).where("r.ok IS NULL OR NOT r.ok")
    # The valid beginning is what is left of the first symbol that isn't in the alphabet.
    place = F.length(F.regexp_extract("r.s", f"^[{SYMBOLS}]*", 0))
    reason = F.when(F.col("r.s").isNull(), "no sequence").otherwise("invalid symbol")
    return bad.select(*others, "r.column", place.alias("place"), F.substring(F.col("r.s"), place + 1, F.lit(1)).alias("symbol"), reason.alias("reason"))


def accepted(df: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``df`` whose sequences are all valid: those that ``rejected`` doesn't report."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(is_valid(F.col(c)), F.lit(False))
    return df.where(ok)


def is_valid(s: Column) -> Column:
    return s.rlike(f"^[{SYMBOLS}]*$")


def validated(s: Column) -> Column:
    """The sequence itself; the query fails on a symbol outside the alphabet."""
    return F.when(is_valid(s), s).when(s.isNotNull(), F.raise_error(F.concat(F.lit("invalid DNA: "), F.left(s, F.lit(60)))))


def is_ambiguous(c: Column) -> Column:
    """For a single symbol; null outside the alphabet."""
    return F.when(c.rlike(f"^[{PLAIN}]$"), F.lit(False)).when(c.rlike(f"^[{''.join(IUPAC)}]$"), F.lit(True))


def count_ambiguous(s: Column) -> Column:
    """Number of ambiguity codes; null for invalid sequences."""
    return F.when(is_valid(s), F.length(F.regexp_replace(s, f"[{PLAIN}]", "")))


def at_most_ambiguous(s: Column, most: int) -> Column:
    """Whether the sequence is valid and has at most ``most`` ambiguity codes, in one pass."""
    return s.rlike(f"^[{PLAIN}]*+(?:[{''.join(IUPAC)}][{PLAIN}]*+){{0,{most}}}$")


def few_ambiguous(s: Column, most: int) -> Column:
    """Whether there are at most ``most`` ambiguity codes; the query fails on a symbol outside the alphabet."""
    if not most:
        # Plain sequences are valid: most are looked at once.
        return F.when(s.rlike(f"^[{PLAIN}]*$"), F.lit(True)).when(is_valid(s), F.lit(False)).when(s.isNotNull(), F.raise_error(F.concat(F.lit("invalid DNA: "), F.left(s, F.lit(60)))))
    few = F.length(F.regexp_replace(s, f"[{PLAIN}]+", "")) <= most
    return F.when(is_valid(s), few).when(s.isNotNull(), F.raise_error(F.concat(F.lit("invalid DNA: "), F.left(s, F.lit(60)))))


def as_dna(s: Column) -> Column:
    """U written as T."""
    return F.replace(s, F.lit("U"), F.lit("T"))


def reverse_complement(s: Column) -> Column:
    """Also of ambiguity codes; null if the sequence holds U or an invalid symbol."""
    return F.when(s.rlike(f"^[{COMPLEMENT[0]}]*$"), F.translate(F.reverse(s), *COMPLEMENT))


def reverse_complement_of(s: str) -> str:
    return s[::-1].translate(str.maketrans(*COMPLEMENT))


def slice_of(s: Column, start: Column | int, length: Column | int) -> Column:
    """``length`` symbols from the 0-based ``start``."""
    return F.substring(s, (F.lit(start) if isinstance(start, int) else start) + 1, F.lit(length) if isinstance(length, int) else length)


def error_probability(ne: Column, length: Column, eps: float) -> Column:
    """Probability of reading ``length`` symbols with ``ne`` errors."""
    return F.pow(F.lit(eps / 3), ne) * F.pow(F.lit(1 - eps), length - ne)


def rounded_count(x: Column) -> Column:
    """Half away from zero as a long; NaN and null give 0."""
    return F.round(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))).cast("long")


def threshold(frequency: float, total: Column, least: int) -> Column:
    return F.greatest(F.lit(frequency) * total, F.lit(float(least)))


def match_masks(compat: bool = True) -> np.ndarray:
    """By byte: the bases that a pattern symbol matches, as bits. With ``compat`` S matches G only, as profiles are scored today."""
    table = np.zeros(256, np.uint8)
    for symbol, bases in {**{b: b for b in "ACGT"}, "U": "", **IUPAC}.items():
        table[ord(symbol)] = sum(_BIT[b] for b in bases)
    if compat:
        table[ord("S")] = _BIT["G"]
    return table


def base_bits() -> np.ndarray:
    """By byte: the bit of a literal base; ambiguity codes in a literal have none and match nothing."""
    table = np.zeros(256, np.uint8)
    for base, bit in _BIT.items():
        table[ord(base)] = bit
    return table


def bytes_of(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("ascii", "replace"), np.uint8)


def mismatch_count(pattern: str, literal: str, compat: bool = True, strict: bool = False) -> int:
    """Mismatches over the shorter length; with ``strict``, lengths must be equal."""
    if strict and len(pattern) != len(literal):
        raise InvalidDimensions(f"lengths differ: {len(pattern)} and {len(literal)}")
    n = min(len(pattern), len(literal))
    return int(((match_masks(compat)[bytes_of(pattern)[:n]] & base_bits()[bytes_of(literal)[:n]]) == 0).sum())


@F.pandas_udf(IntegerType())
def mismatches(pattern: pd.Series, literal: pd.Series) -> pd.Series:
    """Positions, over the shorter length, where the pattern doesn't match the literal; not symmetric."""
    none = (pattern.isna() | literal.isna()).to_numpy()
    pairs = [(p[: len(s)], s[: len(p)]) for p, s in zip(pattern.where(~none, ""), literal.where(~none, ""))]
    size = np.fromiter((len(p) for p, _ in pairs), np.int64, len(pairs))
    apart = (match_masks()[bytes_of("".join(p for p, _ in pairs))] & base_bits()[bytes_of("".join(s for _, s in pairs))]) == 0
    total = np.r_[0, np.cumsum(apart)]
    end = np.cumsum(size)
    return pd.Series(total[end] - total[end - size], dtype="Int32").mask(none)


def expansions(s: str) -> list[str]:
    """All sequences without ambiguity codes that ``s`` stands for; the leftmost code varies fastest."""
    places = [k for k, c in enumerate(s) if c in IUPAC]
    out, chars = [], list(s)
    for choice in product(*(IUPAC[s[k]] for k in reversed(places))):
        for k, c in zip(reversed(places), choice):
            chars[k] = c
        out.append("".join(chars))
    return out


class _Expand:
    """Expansions one at a time: the next one changes one symbol of the last, as a counter does."""

    def eval(self, s: str):
        if s is None:
            return
        chars = list(s)
        places = [(k, IUPAC[c]) for k, c in enumerate(chars) if c in IUPAC]
        digits = [0] * len(places)
        for k, bases in places:
            chars[k] = bases[0]
        while True:
            yield ("".join(chars),)
            for n, (k, bases) in enumerate(places):  # the leftmost code varies fastest
                digits[n] = (digits[n] + 1) % len(bases)
                chars[k] = bases[digits[n]]
                if digits[n]:
                    break
            else:
                return


def is_coded(s: Column) -> Column:
    """Whether there is an ambiguity code."""
    return s.rlike(f"[{''.join(IUPAC)}]")


_OF_BYTES = np.array([["ACGT"[byte >> shift & 3] for shift in (6, 4, 2, 0)] for byte in range(256)], "S1")
_DIGITS = np.full(256, 255, np.uint8)
_DIGITS[bytes_of("ACGT")] = range(4)
#: What stands before a sequence, by its length modulo four: a C, and A so that bytes are full.
_FILL = ("AAAC", "AAC", "AC", "C")


@F.pandas_udf(BinaryType())
def packed(s: pd.Series) -> pd.Series:
    """Four bases to a byte, after a C that marks where they begin, for sequences that are shuffled; the query fails on other symbols than A, C, G and T."""
    texts = ["" if x is None else x for x in s]
    digits = _DIGITS[bytes_of("".join(_FILL[len(x) % 4] + x for x in texts))]
    if (digits > 3).any():
        raise InvalidDna("invalid DNA: " + next(x for x in texts if set(x) - set("ACGT"))[:60])
    four = digits.reshape(-1, 4)
    data = (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).tobytes()
    ends = np.cumsum([0, *(len(x) // 4 + 1 for x in texts)]).tolist()
    return pd.Series([None if x is None else data[a:b] for x, a, b in zip(s, ends[:-1], ends[1:])], dtype=object)


@F.pandas_udf(StringType())
def unpacked(s: pd.Series) -> pd.Series:
    """The bases of ``packed``; all of a batch are looked up together."""
    own = [b"" if x is None else x for x in s]
    bases = _OF_BYTES[np.frombuffer(b"".join(own), np.uint8)].tobytes().decode("ascii")
    ends = np.cumsum([0, *map(len, own)]) * 4
    return pd.Series([None if x is None else bases[a:b].lstrip("A")[1:] for x, a, b in zip(s, ends[:-1].tolist(), ends[1:].tolist())], dtype=object)


#: Expansions, and bytes of them, that are made at a time.
EXPANSIONS, EXPANDED_BYTES = 1 << 16, 4 << 20
_SIZES, _CHOICES = np.ones(256, np.int64), np.zeros((256, 4), np.uint8)
for _c, _bases in IUPAC.items():
    _SIZES[ord(_c)], _CHOICES[ord(_c), : len(_bases)] = len(_bases), bytes_of(_bases)


def _expanded_together(data: np.ndarray, begin: np.ndarray, number: np.ndarray) -> pa.Array:
    """The expansions of all of some sequences, one sequence after another: ``data`` from ``begin`` to the next ``begin``, which have ``number`` of them."""
    size, first = np.diff(begin), np.cumsum(number) - number
    # Bytes of the expansions: those of the sequence, as often as it has expansions.
    source = np.repeat(np.arange(len(number)), number)
    ends = np.r_[0, np.cumsum(size[source])]
    out = data[np.repeat(begin[:-1][source] - ends[:-1], size[source]) + np.arange(ends[-1])]
    # A code's base changes each time that all codes before it have run through theirs: these are 2, 3 or 4, so their product is one of powers of 2 and 3.
    code = np.flatnonzero(_SIZES[data] > 1)
    if len(code):
        row, ways = np.searchsorted(begin, code, side="right") - 1, _SIZES[data[code]]
        stride = np.ones(len(code), np.int64)
        for prime, power in ((2, np.array([0, 0, 1, 0, 2])[ways]), (3, (ways == 3).astype(np.int64))):
            before = np.cumsum(power) - power
            stride *= prime ** (before - before[np.searchsorted(row, row)])
        often = number[row]
        at = np.repeat(np.arange(len(code)), often)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(often) - often, often)
        place = ends[first[row][at] + nth] + (code - begin[row])[at]
        out[place] = _CHOICES[data[code][at], nth // stride[at] % ways[at]]
    return pa.StringArray.from_buffers(len(source), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out))


def expanded_rows(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(rows of the batch, an expansion for each) in pieces of bounded size; a sequence that has very many is taken one expansion at a time."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.string())
    rows = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
    texts = texts.drop_null()
    if not len(rows):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    # Powers of 4 at most: exact as floats as far as they are used.
    logs = np.r_[0.0, np.cumsum(np.log2(_SIZES[data]))][ends]
    number = np.rint(np.exp2(np.minimum(np.diff(logs), 62))).astype(np.int64)
    size = number * np.maximum(np.diff(ends), 1).astype(float)
    many = (number > EXPANSIONS) | (size > EXPANDED_BYTES)
    piece = np.maximum(np.cumsum(np.where(many, 0, number)) // EXPANSIONS, np.cumsum(np.where(many, 0, size)) // EXPANDED_BYTES)
    cuts = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | many[1:] | many[:-1], True])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if not many[a]:
            yield np.repeat(rows[a:b], number[a:b]), _expanded_together(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], number[a:b])
            continue
        one = (v for (v,) in _Expand().eval(texts[a].as_py()))
        step = max(1, EXPANDED_BYTES // max(int(ends[b] - ends[a]), 1))
        while some := list(islice(one, min(step, EXPANSIONS))):
            yield np.full(len(some), rows[a]), pa.array(some, pa.string())


@F.arrow_udf(ArrayType(StringType()))
def disambiguate(s: pa.Array) -> pa.Array:
    """Array of expansions; null for null. The number grows by up to four with each code: filter by their count first. A batch is expanded together."""
    pieces = [*expanded_rows(pa.RecordBatch.from_arrays([s], names=["s"]), "s")]
    number = sum((np.bincount(rows, minlength=len(s)) for rows, _ in pieces), np.zeros(len(s), np.int64))
    found = pa.concat_arrays([pa.array([], pa.string()), *[v for _, v in pieces]])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(number)], pa.int32()), found, mask=s.is_null())


def expanded(df: DataFrame, column: str, name: str) -> DataFrame:
    """A row of ``df`` for each expansion of ``column``, as ``name``. Expansions stream in pieces of bounded size, they are never an array; rows with null have none."""
    schema = StructType([*df.schema.fields, StructField(name, StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in expanded_rows(batch, column):
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, found], names=schema.names)

    return df.mapInArrow(each, schema)


def pssm(primer: str, pseudocount: float = 0.1) -> list[dict[str, float]]:
    """Log2 odds of each base by position against equal shares, from the primer's expansions."""
    variants = expansions(primer)
    out = []
    for column in zip(*variants):
        counts = {b: column.count(b) + pseudocount for b in "ACGT"}
        total = sum(counts.values())
        out.append({b: float(np.log2(c / total / 0.25)) for b, c in counts.items()})
    return out


def pssm_column(primer: Column, pseudocount: float = 0.1) -> Column:
    """The matrix of ``pssm`` as array<array<double>>: for each position the log2 odds of A, C, G and T.

    A code stands for each of its bases equally often among the expansions, so a position's shares follow from its own code and the number of
    expansions; nothing is expanded.
    """
    shares = {c: [(b in bases) / len(bases) for b in "ACGT"] for c, bases in {**{b: b for b in "ACGT"}, **IUPAC}.items()}
    table = F.from_json(F.lit(json.dumps(shares)), "map<string,array<double>>")
    own = F.transform(F.filter(F.split(primer, ""), lambda c: c != ""), lambda c: F.element_at(table, c))
    # A position with m bases, m = 1 / its largest share, makes m times as many expansions.
    known = F.transform(F.array(own), lambda p: F.struct(p.alias("p"), F.aggregate(p, F.lit(1.0), lambda n, x: n / F.array_max(x)).alias("n")))
    odds = lambda s: F.transform(s["p"], lambda x: F.transform(x, lambda share: F.log2((share * s["n"] + pseudocount) / (s["n"] + 4 * pseudocount) / 0.25)))
    return F.get(F.transform(known, odds), F.lit(0))


def pssm_rows(df: DataFrame, primer: str, pseudocount: float = 0.1, digits: int | None = None) -> DataFrame:
    """The rows of ``df`` once for each position of ``primer``: ``k`` from 0, and its log2 odds ``a``, ``c``, ``g`` and ``t``, rounded to ``digits`` if given.

    The same as ``pssm_column``, for very many primers: a position's base has one of five scores, by the number of bases that its code stands for, so
    logarithms and roundings are taken for a primer, not for each of its positions, and only for numbers of bases that it has. Rows with an empty or
    a null primer have no position.
    """
    bases = {**{b: b for b in "ACGT"}, **IUPAC}
    size = {m: "".join(c for c, own in bases.items() if len(own) == m) for m in (1, 2, 3, 4)}
    # What is left of a primer without its plain bases, codes of m bases all written as the first of them; other symbols stay.
    kinds = {m: size[m][0] for m in (2, 3, 4)}
    kind = F.translate(F.col(primer), size[2] + size[3] + size[4] + size[1], "".join(c * len(size[m]) for m, c in kinds.items()))
    counted = df.where(F.length(primer) > 0).withColumn("_kinds", kind).withColumn("_left", F.length("_kinds"))
    counted = counted.withColumns({f"_of{m}": F.col("_left") - F.length(F.replace("_kinds", F.lit(c), F.lit(""))) for m, c in kinds.items()})
    number = F.lit(1.0)
    for m in kinds:
        number = number * F.pow(F.lit(float(m)), F.col("_left") - sum(F.col(f"_of{x}") for x in kinds if x != m))
    counted = counted.withColumn("_n", number)

    def odds(count: Column) -> Column:
        x = F.log2((count + pseudocount) / (F.col("_n") + 4 * pseudocount) / 0.25)
        return x if digits is None else F.round(x, digits)

    scored = counted.withColumns({"_0": odds(F.lit(0.0)), "_1": odds(F.col("_n")), **{f"_{m}": F.when(F.col(f"_of{m}") > 0, odds(F.col("_n") / m)) for m in kinds}})
    each = scored.withColumn("k", F.explode(F.sequence(F.lit(0), F.length(primer) - 1)))
    # Symbols in the order of their bases as bits: the place of a symbol, from 1, has a bit for each base, and 0 is no symbol.
    symbols = "".join(sorted(bases, key=lambda c: sum(_BIT[b] for b in bases[c])))
    each = each.withColumn("_bases", F.instr(F.lit(symbols), F.substring(F.col(primer), F.col("k") + 1, F.lit(1)))).withColumn("_m", F.bit_count("_bases"))
    hit = F.when(F.col("_m") == 1, F.col("_1")).when(F.col("_m") == 2, F.col("_2")).when(F.col("_m") == 3, F.col("_3")).otherwise(F.col("_4"))
    each = each.withColumn("_hit", hit)
    found = [F.when(F.col("_bases").bitwiseAND(F.lit(bit)) > 0, F.col("_hit")).otherwise(F.col("_0")).alias(b.lower()) for b, bit in _BIT.items()]
    return each.select(*df.columns, "k", *found)


def best_scores(primers: list[str], pseudocount: float = 0.1):
    """A function of a sequence column: for each primer the place (from 0) with the highest score and that score, null where the sequence is shorter.

    A symbol other than A, C, G and T adds nothing. Of equal scores the leftmost counts. One pass over a batch for each position of a primer.
    """
    tables = []
    for p in primers:
        table = np.zeros((len(p), 256))
        for k, odds in enumerate(pssm(p, pseudocount)):
            for b, x in odds.items():
                table[k, ord(b)] = x
        tables.append(table)

    @F.pandas_udf("array<struct<score:double,pos:int>>")
    def of(sequence: pd.Series) -> pd.Series:
        texts = sequence.fillna("").tolist()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(size) - size
        symbols = bytes_of("".join(texts))
        out: list[list] = [[] for _ in texts]
        for table in tables:
            width = len(table)
            places = max(len(symbols) - width + 1, 0)
            score = np.zeros(places)
            for k in range(width):
                score += table[k][symbols[k : k + places]]
            for row, a, n in zip(out, begin.tolist(), size.tolist()):
                if n < width:
                    row.append(None)
                else:
                    # Scores of equal places may differ in their last bits: ties are to nine digits.
                    own = np.round(score[a : a + n - width + 1], 9)
                    row.append({"score": float(own.max()), "pos": int(own.argmax())})
        return pd.Series(out, dtype=object)

    return of.asNondeterministic()


def register(spark: SparkSession) -> None:
    """SQL names for the kernels and the common expressions."""
    spark.udf.register("dna_mismatches", mismatches)
    spark.udf.register("dna_disambiguate", disambiguate)
    spark.udtf.register("dna_expansions", F.udtf(_Expand, returnType="variant string"))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION dna_reverse_complement(s STRING) RETURNS STRING RETURN CASE WHEN s RLIKE '^[{COMPLEMENT[0]}]*$' THEN translate(reverse(s), '{COMPLEMENT[0]}', '{COMPLEMENT[1]}') END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION dna_count_ambiguous(s STRING) RETURNS INT RETURN CASE WHEN s RLIKE '^[{SYMBOLS}]*$' THEN length(regexp_replace(s, '[{PLAIN}]', '')) END")
