"""Document fingerprints: SimHash by weighted votes of term hashes, searched through permuted block tables.

Only DataFrame functions. A term is a word; its weight grows with the square of its length, so that function words of a
language count for little. Votes are summed for two bits at a time in the 32-bit halves of a long; the sums of at most
``LANE_TERMS`` terms are then added as longs of their own.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliflow.llm.common import id_or_marker, id_or_null, materialize, words_of

BITS = 128
RADIUS = 3
_PAIR = (1 << 32) | 1
#: Terms of a key whose votes share a long; the weights of these stay below 1 << 31.
LANE_TERMS = 1 << 23


def term_weight(word: Column) -> Column:
    short = F.greatest(F.least(F.length(word), F.lit(16)) - 3, F.lit(1)).cast("long")
    return short * short


def fingerprints(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys`` with ``fp_hi`` and ``fp_lo``: a 128-bit fingerprint of each key's text.

    A bit is set if the terms that set it outweigh the others; null texts and texts without words get zero. A key has one row.
    """
    terms = rows.select(*keys, F.posexplode_outer(words_of(F.col(text_col))).alias("_at", "_t")).withColumn("_part", F.floor(F.coalesce("_at", F.lit(0)) / LANE_TERMS))
    terms = terms.select(*keys, "_part", F.when(F.col("_t").isNotNull(), term_weight(F.col("_t"))).otherwise(F.lit(0)).alias("_w"), F.xxhash64("_t").alias("_h0"), F.xxhash64(F.lit(1), "_t").alias("_h1"))
    pairs = [(half, k) for half in (0, 1) for k in range(32)]
    votes = [F.sum(F.col("_w") * F.shiftright(f"_h{half}", k).bitwiseAND(F.lit(_PAIR))).alias(f"_v{half}_{k}") for half, k in pairs]
    parts = terms.groupBy(*keys, "_part").agg(F.sum("_w").alias("_w"), *votes)
    lanes = [F.sum(x).alias(f"_l{half}_{at}") for half, k in pairs for at, x in ((k, F.col(f"_v{half}_{k}").bitwiseAND(F.lit(0xFFFFFFFF))), (k + 32, F.shiftrightunsigned(f"_v{half}_{k}", 32)))]
    summed = parts.groupBy(*keys).agg(F.sum("_w").alias("_w"), *lanes)

    def bits(half: int) -> Column:
        out = F.lit(0).cast("long")
        for at in range(64):
            out = out.bitwiseOR(F.when(2 * F.col(f"_l{half}_{at}") > F.col("_w"), F.lit(1 << at if at < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    return summed.select(*keys, bits(1).alias("fp_hi"), bits(0).alias("fp_lo"))


def hex_of(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(d: Column) -> Column:
    """The cosine of the weighted term vectors as the share of differing bits estimates it, not below 0."""
    return F.greatest(F.cos(d * (3.141592653589793 / BITS)), F.lit(0.0))


def block_tables(fps: DataFrame, radius: int = RADIUS, lead: int = 1) -> DataFrame:
    """Each fingerprint once for each table, with the table's number and its leading blocks as ``bt_table``, ``bt_key``.

    The bits are cut into ``radius + lead`` blocks. For each choice of ``lead`` blocks there is a table that is permuted
    so that these come first. Fingerprints within ``radius`` agree on all the leading blocks of one table or more.
    """
    blocks = radius + lead
    edges = [BITS * b // blocks for b in range(blocks + 1)]

    def part(a: int, b: int) -> list[Column]:
        """Bits a to b, from the lowest, of both halves."""
        out = []
        for name, base in (("fp_lo", 0), ("fp_hi", 64)):
            lo, hi = max(a - base, 0), min(b - base, 64)
            if lo < hi:
                mask = (1 << (hi - lo)) - 1 if hi - lo < 64 else -1
                out.append(F.shiftrightunsigned(name, lo).bitwiseAND(F.lit(mask)))
        return out

    tables = [
        F.struct(F.lit(t).alias("bt_table"), F.xxhash64(*[x for b in chosen for x in part(edges[b], edges[b + 1])]).alias("bt_key"))
        for t, chosen in enumerate(combinations(range(blocks), lead))
    ]
    return fps.select("*", F.explode(F.array(*tables)).alias("_bt")).select(*fps.columns, "_bt.*")


def search(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, lead: int = 1) -> DataFrame:
    """Pairs of distinct fingerprints within ``radius``: ``q_hi, q_lo`` of the queries with ``fp_hi, fp_lo, distance``.

    Both inputs have distinct ``fp_hi, fp_lo``. A pair comes from the first table that finds it, so it comes once.
    """
    q = block_tables(queries.select("fp_hi", "fp_lo"), radius, lead).select(F.col("fp_hi").alias("q_hi"), F.col("fp_lo").alias("q_lo"), F.col("bt_table").alias("q_table"), F.col("bt_key").alias("q_key"))
    t = block_tables(fps, radius, lead)
    d = distance((F.col("q_hi"), F.col("q_lo")), (F.col("fp_hi"), F.col("fp_lo")))
    found = q.join(t, (F.col("q_table") == F.col("bt_table")) & (F.col("q_key") == F.col("bt_key")) & (d <= radius))
    return found.withColumn("distance", d).drop("q_table", "q_key", "bt_table", "bt_key").dropDuplicates(["q_hi", "q_lo", "fp_hi", "fp_lo"])


def _followers(docs: DataFrame) -> DataFrame:
    """For each distinct (doc_id, tie, n_chars): how many rows it has and the next one in ascending order, cyclically.

    Rows are ordered by ranges; only the first of each range is looked at across ranges.
    """
    order = ["doc_id", "tie"]
    rows = docs.groupBy("doc_id", "tie", "n_chars").agg(F.count(F.lit(1)).alias("copies"))
    rows = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "op1-order")
    first = rows.groupBy("part").agg(F.min(F.struct(*order)).alias("f"))  # a row for each range
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = first.select("part", F.coalesce(F.lead("f").over(Window.orderBy("part")), F.first("f").over(everything)).alias("after"))
    inside = Window.partitionBy("part").orderBy(*order)
    rows = rows.withColumn("inner_next", F.lead(F.struct(*order)).over(inside)).join(F.broadcast(first), "part", "left")
    following = F.coalesce("inner_next", "after")
    return rows.select(*order, "n_chars", "copies", following["doc_id"].alias("next_id"), following["tie"].alias("next_tie"))


def op1_query(docs: DataFrame) -> DataFrame:
    """A row for each input row: the document's fingerprint, that of its edited text, and how like it is to both that and the next.

    ``n_within`` counts the rows within ``RADIUS`` bits for documents whose id is divisible by 50 (null for others).
    Null texts are empty. Rows that share a doc_id are ordered by a hash of their texts; rows that share both are equal.
    Rows without an id come first and are rows like any other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(id_or_marker("doc_id").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    links = _followers(keyed.select("doc_id", "tie", F.length("text").cast("long").alias("n_chars")))
    keyed = keyed.dropDuplicates(["doc_id", "tie"])  # ``copies`` brings the others back
    wanted = links.select(F.col("next_id").alias("doc_id"), F.col("next_tie").alias("tie"), F.col("doc_id").alias("for_id"), F.col("tie").alias("for_tie"), (F.col("n_chars") / 4).cast("int").alias("take"))
    heads = keyed.join(wanted, ["doc_id", "tie"]).select(F.col("for_id").alias("doc_id"), F.col("for_tie").alias("tie"), F.substring("text", F.lit(1), F.col("take")).alias("head"))
    pairs = keyed.join(links.select("doc_id", "tie", "n_chars"), ["doc_id", "tie"]).join(heads, ["doc_id", "tie"])
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")), F.col("head"))
    pairs = pairs.select("doc_id", "tie", "text", edited.alias("edited"))
    both = pairs.select("doc_id", "tie", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("which", "text"))
    fps = materialize(fingerprints(both, ["doc_id", "tie", "edited_sha256", "which"], "text"), "op1-fp")
    own = fps.where("which = 0").drop("which")
    other = fps.where("which = 1").select("doc_id", "tie", F.col("fp_hi").alias("e_hi"), F.col("fp_lo").alias("e_lo"))
    following = own.select(F.col("doc_id").alias("next_id"), F.col("tie").alias("next_tie"), F.col("fp_hi").alias("n_hi"), F.col("fp_lo").alias("n_lo"))
    rows = own.join(other, ["doc_id", "tie"]).join(links, ["doc_id", "tie"]).join(following, ["next_id", "next_tie"])

    weighed = own.join(links.select("doc_id", "tie", "copies"), ["doc_id", "tie"]).groupBy("fp_hi", "fp_lo").agg(F.sum("copies").alias("n_rows"))
    asked = own.where(F.col("doc_id") % 50 == 0).select("fp_hi", "fp_lo").distinct()
    near = search(asked, weighed).groupBy("q_hi", "q_lo").agg(F.sum("n_rows").alias("n_within"))
    asking = own.where(F.col("doc_id") % 50 == 0).join(near, (F.col("fp_hi") == F.col("q_hi")) & (F.col("fp_lo") == F.col("q_lo"))).select("doc_id", "tie", "n_within")
    rows = rows.join(asking, ["doc_id", "tie"], "left")

    like = lambda hi, lo: likeness(distance((F.col("fp_hi"), F.col("fp_lo")), (F.col(hi), F.col(lo))))
    return rows.select(
        id_or_null("doc_id").alias("doc_id"), "n_chars", "edited_sha256", hex_of(F.col("fp_hi"), F.col("fp_lo")).alias("fingerprint"), hex_of(F.col("e_hi"), F.col("e_lo")).alias("edited_fingerprint"),
        like("e_hi", "e_lo").alias("near_edited"), like("n_hi", "n_lo").alias("near_next"), "n_within", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).drop("copy")
