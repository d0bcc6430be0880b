"""Fill-in-middle documents on ropes.

A rope is a balanced tree over slices of a text; every node knows how many units (words of ASCII letters, other characters one
by one) and how many code points are below it. Two splits at unit ranks give prefix, middle and suffix in time logarithmic in
the text, and the rearranged document is a concatenation of subtrees and sentinels. The inverse builds the rope of a
document, splits it at its sentinels and concatenates the parts in their first order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ampliflow.llm.common import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of a leaf; leaves end where a unit ends, so a very long word is one leaf.
LEAF = 1024
_UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
_REST_OF_WORD = re.compile(r"[A-Za-z]*")
_SENTINEL = re.compile("<[PSM]>")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


class Rope:
    """A leaf with ``text``, or a node with two parts; ``units`` and ``chars`` are those of the whole subtree."""

    __slots__ = ("units", "chars", "text", "left", "right")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.units, self.chars = len(_UNIT.findall(text)), len(text)
        else:
            self.units, self.chars = left.units + right.units, left.chars + right.chars

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                out.append(node.text)
            else:
                todo += (node.right, node.left)
        return "".join(out)


def rope(text: str, leaf: int = LEAF) -> Rope:
    """The balanced rope of a text."""
    nodes, at = [], 0
    while at < len(text):
        end = at + leaf
        if end < len(text) and text[end - 1] in _LETTERS:
            end = _REST_OF_WORD.match(text, end).end()
        nodes.append(Rope(text[at:end]))
        at = end
    while len(nodes) > 1:
        pairs = [Rope(left=a, right=b) for a, b in zip(nodes[::2], nodes[1::2])]
        nodes = pairs + nodes[len(pairs) * 2 :]
    return nodes[0] if nodes else Rope()


def concat(*parts: Rope) -> Rope:
    """The parts one after another. Units add up because no joint falls inside a word: parts begin and end where units do."""
    whole = parts[0]
    for part in parts[1:]:
        whole = part if not whole.chars else whole if not part.chars else Rope(left=whole, right=part)
    return whole


def split(node: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first ``rank`` units (or code points, with ``by="chars"``) and the rest."""
    if rank <= 0:
        return Rope(), node
    if rank >= getattr(node, by):
        return node, Rope()
    if node.left is None:
        at = rank if by == "chars" else next(islice(_UNIT.finditer(node.text), rank - 1, None)).end()
        return Rope(node.text[:at]), Rope(node.text[at:])
    before = getattr(node.left, by)
    if rank < before:
        a, b = split(node.left, rank, by)
        return a, concat(b, node.right)
    a, b = split(node.right, rank - before, by)
    return concat(node.left, a), b


@dataclass(frozen=True)
class Rates:
    """Percentages: of documents that are rearranged, and of these the ones with the suffix first. ``seed`` names the draw."""

    rearranged: int = 90
    suffix_first: int = 20
    seed: int = 1


def draws(doc_id: str, seed: int = 1) -> list[int]:
    """Four numbers below 2^32 that depend on the id only."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def rearrange(text: str, doc_id: str, rates: Rates = Rates(), leaf: int = LEAF) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix and of the middle, document)."""
    h1, h2, h3, h4 = draws(doc_id, rates.seed)
    tree = rope(text, leaf)
    n = tree.units
    if not n or h3 % 100 >= rates.rearranged or _SENTINEL.search(text):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = split(tree, last)
    prefix, middle = split(head, first)
    p, s, m = Rope(PREFIX), Rope(SUFFIX), Rope(MIDDLE)
    if h4 % 100 < rates.suffix_first:
        form, whole = "spm", concat(s, suffix, p, prefix, m, middle)
    else:
        form, whole = "psm", concat(p, prefix, s, suffix, m, middle)
    return n, form, prefix.chars, middle.chars, str(whole)


def restored(document: str, form: str, leaf: int = LEAF) -> str:
    """The text that a document of a form was made of."""
    if form == "plain":
        return document
    second = SUFFIX if form == "psm" else PREFIX
    tree = rope(document, leaf)
    width = len(PREFIX)
    head, last = split(tree, document.index(MIDDLE), "chars")
    _, middle = split(last, width, "chars")
    _, head = split(head, width, "chars")
    a, b = split(head, document.index(second, width) - width, "chars")
    _, b = split(b, width, "chars")
    return str(concat(a, middle, b) if form == "psm" else concat(b, middle, a))


_RESULT = "units long, form string, prefix_chars long, middle_chars long, text string"


def _rearranging(rates: Rates):
    @F.pandas_udf(_RESULT)
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ids in batches:
            found = pd.DataFrame([rearrange(t, i, rates) for t, i in zip(texts, ids)], columns=["units", "form", "prefix_chars", "middle_chars", "text"])
            yield found.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return of


@F.pandas_udf(StringType())
def _restoring(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for documents, forms in batches:
        yield pd.Series([restored(d, f) for d, f in zip(documents, forms)], dtype=object)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "fim", rates: Rates = Rates()) -> DataFrame:
    """``docs`` with a struct ``out_col``: units, form ("plain", "psm" or "spm"), prefix_chars, middle_chars (null if plain) and the document ``text``.

    Null texts count as empty and stay plain, as do texts that hold a sentinel. A null id draws as the empty string. Equal rows have equal
    results; a column named ``out_col`` is replaced, the others stay.
    """
    small_batches(docs.sparkSession)
    text, doc_id = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.withColumn(out_col, _rearranging(rates)(text, doc_id))


def restore(document: Column, form: Column) -> Column:
    """The text of a document as ``fill_in_middle`` gave it, from the document and its form alone."""
    return _restoring(document, form)


def op11_query(docs: DataFrame) -> DataFrame:
    found = fill_in_middle(docs.select("doc_id", "text"))
    back = F.sha2(restore(F.col("fim.text"), F.col("fim.form")), 256).alias("restored_sha256")
    return found.select("doc_id", F.col("fim.units").alias("n"), "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.text", 256).alias("output_sha256"), back)


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS s, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, s, u, len(u) AS n, {", ".join(f"('0x' || x[{1 + 8 * k}:{8 + 8 * k}])::BIGINT AS h{k + 1}" for k in range(4))} FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN s = '' OR contains(s, '{PREFIX}') OR contains(s, '{SUFFIX}') OR contains(s, '{MIDDLE}') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT doc_id, s, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN s WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || z || '{MIDDLE}' || m ELSE '{SUFFIX}' || z || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(s) AS restored_sha256 FROM c"""
