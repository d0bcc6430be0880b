"""Relative abundances by expectation-maximisation over a mapping, and what is read out of them.

All frames carry ``sample``. A step is two joins and two sums over the non-zero entries. Long runs of small samples go to
one kernel each; its size is checked. Larger samples take the steps as queries over two copies of the entries, bucketed by row and
by group: a step then shuffles partial sums and vectors, never the entries.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliflow.functions.dna import rounded_count
from ampliflow.operators.mapper import Mapping
from ampliflow.operators.staging import bucketed, stage

EPS = 2.220446049250313e-16
#: Least share that counts as present.
FLOOR = 1e-10
#: Non-zero entries of a sample that one kernel takes (a few MB), and of a bucket.
KERNEL_ENTRIES = 200_000
BUCKET_ENTRIES = 2_000_000


def nan_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(float("nan")))


def _share(df: DataFrame, column: str) -> DataFrame:
    """``column`` as a share of the sample's sum; NaN if that is zero."""
    total = df.groupBy("sample").agg(F.sum(column).alias("_total"))
    return df.join(F.broadcast(total), "sample").withColumn(column, nan_divide(F.col(column), F.col("_total"))).drop("_total")


@dataclass
class Estimate:
    """``qg`` (sample, i, g, x), ``pi`` (sample, g, pi) and the L1 change ``l1`` (sample, l1) of the last step, if any.

    ``by_g`` and ``by_i`` are the entries bucketed by group and by row, if there are such copies.
    """

    mapping: Mapping
    qg: DataFrame
    pi: DataFrame
    l1: DataFrame | None = None
    by_g: DataFrame | None = None
    by_i: DataFrame | None = None

    @classmethod
    def start(cls, mapping: Mapping) -> Estimate:
        reps = mapping.groups.where("j = rep_j").select("sample", "j", "g")
        qg = stage(mapping.q.join(reps, ["sample", "j"]).select("sample", "i", "g", "x"), "qg")
        raw = qg.join(mapping.y.select("sample", "i", "y"), ["sample", "i"]).groupBy("sample", "g").agg(F.sum(F.col("x") * F.col("y")).alias("pi"))
        every = reps.select("sample", "g").join(raw, ["sample", "g"], "left").select("sample", "g", F.coalesce("pi", F.lit(0.0)).alias("pi"))
        return cls(mapping, qg, stage(_share(every, "pi"), "pi"))

    def bucketed(self, buckets: int | None = None) -> Estimate:
        """The same with bucketed copies of the entries, for many steps; ``y`` of a row stands beside its entries."""
        if buckets is None:
            buckets = max(self.qg.sparkSession.sparkContext.defaultParallelism, -(-self.qg.count() // BUCKET_ENTRIES))
        entries = self.qg.join(self.mapping.y.select("sample", "i", "y"), ["sample", "i"])
        return replace(self, by_g=bucketed(self.qg, ["sample", "g"], buckets, "qg_by_g"), by_i=bucketed(entries, ["sample", "i"], buckets, "qg_by_i"))

    def _update(self) -> DataFrame:
        """(sample, g, pi, change) after a step."""
        if self.by_g is None:
            by_g, by_i = self.qg, self.qg.join(self.mapping.y.select("sample", "i", "y"), ["sample", "i"])
        else:
            by_g, by_i = self.by_g, self.by_i
        theta = by_g.join(self.pi, ["sample", "g"]).groupBy("sample", "i").agg(F.sum(F.col("x") * F.col("pi")).alias("theta"))
        factor = by_i.join(theta, ["sample", "i"]).groupBy("sample", "g").agg(F.sum(F.col("x") * F.col("y") / (F.col("theta") + EPS)).alias("f"))
        after = self.pi.join(factor, ["sample", "g"], "left").withColumn("f", F.coalesce("f", F.lit(0.0)))
        return after.select("sample", "g", (F.col("pi") * F.col("f")).alias("pi"), (F.abs(1 - F.col("f")) * F.col("pi")).alias("change"))

    def _stepped(self) -> Estimate:
        after = stage(self._update(), "pi")
        return replace(self, pi=after.select("sample", "g", "pi"), l1=after.groupBy("sample").agg(F.sum("change").alias("l1")))

    def step(self) -> Estimate:
        """One update; ``l1`` is the change that it makes."""
        if self.by_g is not None:
            return self._stepped()
        joined = self.qg.join(self.pi, ["sample", "g"])
        theta = joined.groupBy("sample", "i").agg(F.sum(F.col("x") * F.col("pi")).alias("theta"))
        weight = theta.join(self.mapping.y.select("sample", "i", "y"), ["sample", "i"]).select("sample", "i", (F.col("y") / (F.col("theta") + EPS)).alias("w"))
        factor = self.qg.join(weight, ["sample", "i"]).groupBy("sample", "g").agg(F.sum(F.col("x") * F.col("w")).alias("f"))
        after = self.pi.join(factor, ["sample", "g"], "left").withColumn("f", F.coalesce("f", F.lit(0.0)))
        after = stage(after.select("sample", "g", (F.col("pi") * F.col("f")).alias("pi"), (F.abs(1 - F.col("f")) * F.col("pi")).alias("change")), "pi")
        return replace(self, pi=after.select("sample", "g", "pi"), l1=after.groupBy("sample").agg(F.sum("change").alias("l1")))

    def refine(self, n: int = 10_000, tol: float = 5e-7) -> Estimate:
        """Up to ``n`` steps for each sample; the step that changes less than ``tol`` is its last."""
        most = self.qg.groupBy("sample").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= KERNEL_ENTRIES:
            return self._refine_kernel(n, tol)
        now = self if self.by_g is not None else self.bucketed()
        for _ in range(n):
            before, now = now, now.step()
            if tol > 0:
                # Samples that have converged keep what they had before the round.
                done = before.l1.where(F.col("l1") < tol).select("sample") if before.l1 is not None else None
                if done is not None and not done.isEmpty():
                    kept = before.pi.join(done, "sample").unionByName(now.pi.join(done, "sample", "left_anti"))
                    change = before.l1.join(done, "sample").unionByName(now.l1.join(done, "sample", "left_anti"))
                    now = replace(now, pi=stage(kept, "pi"), l1=stage(change, "l1"))
                if now.l1.where((F.col("l1") >= tol) | F.isnan("l1")).isEmpty():
                    break
        return now

    def _refine_kernel(self, n: int, tol: float) -> Estimate:
        entries = self.qg.join(self.mapping.y.select("sample", "i", "y"), ["sample", "i"])

        def run(key, q: pd.DataFrame, pi: pd.DataFrame) -> pd.DataFrame:
            pi = pi.sort_values("g")
            share = pi["pi"].to_numpy().copy()
            q = q.sort_values(["i", "g"])
            rows, i = np.unique(q["i"].to_numpy(), return_inverse=True)
            g, x = np.searchsorted(pi["g"].to_numpy(), q["g"].to_numpy()), q["x"].to_numpy()
            y = np.zeros(len(rows))
            y[i] = q["y"].to_numpy()
            l1 = float("nan")
            for _ in range(n):
                theta = np.bincount(i, x * share[g], len(rows))
                f = np.bincount(g, x * (y / (theta + EPS))[i], len(share))
                l1 = float((np.abs(1 - f) * share).sum())
                share *= f
                if l1 < tol:
                    break
            return pd.DataFrame({"sample": pi["sample"].to_numpy(), "g": pi["g"].to_numpy(), "pi": share, "l1": l1})

        done = entries.groupBy("sample").cogroup(self.pi.groupBy("sample")).applyInPandas(run, "sample string, g long, pi double, l1 double")
        nan = F.lit(float("nan"))  # pandas hands it back as null
        done = stage(done.select("sample", "g", F.coalesce("pi", nan).alias("pi"), F.coalesce("l1", nan).alias("l1")), "refined")
        return replace(self, pi=done.select("sample", "g", "pi"), l1=done.groupBy("sample").agg(F.max("l1").alias("l1")))

    def proportions(self) -> DataFrame:
        """(sample, j, proportion): each member has its group's whole share; shares below the floor are 0."""
        present = F.when(F.col("pi") >= FLOOR, F.col("pi")).when(F.isnan("pi"), F.col("pi")).otherwise(0.0)
        members = self.mapping.groups.join(self.pi, ["sample", "g"]).select("sample", "j", present.alias("proportion"))
        return _share(members, "proportion")

    def frequencies(self) -> DataFrame:
        """(sample, j, proportion, frequency): proportions by the number of amplified regions."""
        refs = self.mapping.database.refs.select("j", "amplified")
        each = self.proportions().join(refs, "j").withColumn("frequency", F.col("proportion") / (F.col("amplified") + EPS))
        return _share(each, "frequency").select("sample", "j", "proportion", "frequency")

    def mapped_by_reference(self) -> DataFrame:
        """(sample, j, mapped): reads by reference. Shares are taken within a reference, so the counts need not add up."""
        freq = self.frequencies()
        c = self.mapping.q.join(freq, ["sample", "j"]).join(self.mapping.y.select("sample", "i", F.col("n").alias("reads")), ["sample", "i"])
        c = c.withColumn("c", F.col("x") * F.col("frequency")).groupBy("sample", "j").agg(F.sum("c").alias("total"), F.sum(F.col("c") * F.col("reads")).alias("read_sum"))
        every = freq.select("sample", "j").join(c, ["sample", "j"], "left")
        return every.select("sample", "j", rounded_count(F.col("read_sum") / (F.col("total") + EPS)).alias("mapped"))

    def report(self, taxonomy: DataFrame | None = None, strict: bool = False, least: float = 0.0) -> DataFrame:
        """(sample, id, taxonomy, proportion, frequency, mapped) of references with a frequency above ``least``.

        With ``strict`` a reference without a lineage is an error.
        """
        rows = self.frequencies().where(F.col("frequency") > least).join(self.mapped_by_reference(), ["sample", "j"]).join(self.mapping.database.refs.select("j", "name"), "j")
        if taxonomy is None:
            lineage = F.lit(None).cast("string")
        else:
            rows = rows.join(taxonomy.select(F.col("id").alias("_id"), "lineage"), F.col("name") == F.col("_id"), "left")
            lineage = F.when(F.col("lineage").isNull(), F.raise_error(F.concat(F.lit("no lineage for "), "name"))).otherwise(F.col("lineage")) if strict else F.col("lineage")
        return rows.select("sample", "j", F.col("name").alias("id"), lineage.alias("taxonomy"), "proportion", "frequency", "mapped")

    def arrays(self, sample: str = "") -> dict[str, np.ndarray]:
        """Proportions, frequencies and mapped reads of one sample as arrays by reference, and assigned and mapped reads by region.

        For use beside the tables: an array has a value for each reference, which the driver must hold.
        """
        rows = self.frequencies().join(self.mapped_by_reference(), ["sample", "j"]).where(F.col("sample") == sample).orderBy("j").toPandas()
        out = {c: rows[c].to_numpy() for c in ("proportion", "frequency", "mapped")}
        for name in ("assigned", "mapped"):
            counts = dict(getattr(self.mapping, name).where(F.col("sample") == sample).select("region", "n").collect())
            out[f"{name}_by_region"] = np.array([counts.get(r["region"], 0) for r in self.mapping.database.primers.select("region").orderBy("region").collect()])
        return out
