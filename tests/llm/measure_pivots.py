"""What whole documents as pivots of a first distributed stage would cost: ``python -m tests.llm.measure_pivots DIR [PIVOTS]``.

Sets are dealt to the Voronoi regions of random pivots, and copied to each region whose pivot is at most 2 eps farther
than the nearest one. Prints copies of a set, and the bytes of shingles that a shuffle of all copies would move.
"""

import sys
import time
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleanmill.llm import jaccard, runtime


def copies(rule, pivots, batches):
    """Rows (text) to (n, copies)."""
    flat, owner, sizes = pivots.value
    eps = 1 - rule.num / rule.den
    for batch in batches:
        for _, sets in jaccard._sets(batch.column(0), rule):
            out = []
            for s in sets:
                lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                hits = hi - lo
                at = np.repeat(lo - (np.cumsum(hits) - hits), hits) + np.arange(int(hits.sum()))
                common = np.bincount(owner[at], minlength=len(sizes))
                distance = 1 - common / (sizes + len(s) - common).clip(1)
                out.append((len(s), int((distance <= distance.min() + 2 * eps + 1e-9).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["n", "copies"])


def main(folder: str, pivots: int) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    runtime.ship(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for rule in (jaccard.Rule(3, 90, 100), jaccard.Rule()):
        chosen = docs.orderBy(F.xxhash64("doc_id")).limit(pivots).select("text").toArrow().column(0).combine_chunks()
        sets = [s for _, x in jaccard._sets(chosen, rule) for s in x]
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        shared = spark.sparkContext.broadcast((every[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order], np.array([len(s) for s in sets])))
        began = time.time()
        r = docs.select(F.col("text").cast("string")).mapInArrow(partial(copies, rule, shared), "n long, copies long").agg(F.count("n").alias("sets"), F.avg("copies").alias("copies"), F.sum(8 * F.col("n") * F.col("copies")).alias("bytes"), F.sum(F.octet_length(F.lit(""))).alias("x")).first()
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
        print(f"{rule}: {r.sets} sets, {pivots} pivots, {r.copies:.1f} copies a set, {r.bytes / size:.1f} times the texts to shuffle, {time.time() - began:.0f} s on 8 cores", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 64)
