"""Quality selection by importance resampling.

Words and pairs of neighbouring words of a text are hashed into buckets. Two bag models are
counted: one of the target texts (labelled of good quality) and one of all raw texts. The importance
weight of a document is the likelihood ratio of its features under the two, in logarithms, and
adding Gumbel noise and taking the largest k samples k documents without replacement in proportion
to the weights.

The counts cover all documents: each arrow slice adds up its own, and Spark sums the slices. The
models are two numbers per bucket whatever the corpus. The k-th key is found by counts, not by a sort.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import largest, listed, map_batches, stored, table, text_slices
from pairlens.llm.hashing import RangeHash, words_of

BUCKETS = 1 << 16
#: Added to every count, as a share of the smaller model's mean count.
SMOOTHING = 0.5
SEED = 29
#: Counts leave a task in this many rows of neighbouring buckets.
CHUNKS = 64


def features(texts) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words and word pairs in text order, number of them per text).

    ASCII letters are lower-cased by the caller; a pair does not cross texts.
    """
    words = words_of(texts)
    per_doc = words.words_per_doc
    names = words.words()
    first = words.first_word
    n = 2 * per_doc - (per_doc > 0)
    out = np.empty(int(n.sum()), np.int64)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    at = (np.cumsum(n) - n)[doc] + 2 * (np.arange(len(names)) - first[:-1][doc])
    mask = np.uint64(BUCKETS - 1)
    out[at] = (names & mask).astype(np.int64)
    start = np.flatnonzero(np.arange(len(names)) + 1 < first[1:][doc])
    out[at[start] + 1] = (RangeHash(names).range(start, start + 2, 5) & mask).astype(np.int64)
    return out, n


def _lowered(texts: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.ascii_lower(texts)


def bucket_counts(docs: DataFrame, good: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(counts over the target texts, over all): ``good`` has the doc_ids of the target."""
    ids = listed(stored(good.select("doc_id").distinct().withColumn("target", F.lit(True))))
    marked = docs.select("doc_id", "text").join(ids, "doc_id", "left")
    size = BUCKETS // CHUNKS

    def run(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for rows, texts in text_slices(batch):
                found, n = features(_lowered(texts))
                target = rows.column("target").fill_null(False).to_numpy(zero_copy_only=False)
                total[0] += np.bincount(found[np.repeat(target, n)], minlength=BUCKETS)
                total[1] += np.bincount(found, minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array(range(CHUNKS), pa.int32()),
            "target": pa.array(total[0].reshape(CHUNKS, size).tolist(), pa.list_(pa.int64())),
            "raw": pa.array(total[1].reshape(CHUNKS, size).tolist(), pa.list_(pa.int64())),
        })

    parts = marked.mapInArrow(run, "chunk int, target array<long>, raw array<long>")
    each = parts.select("chunk", F.posexplode(F.arrays_zip("target", "raw")).alias("slot", "n"))
    sums = each.groupBy("chunk", "slot").agg(F.sum("n.target").alias("target"), F.sum("n.raw").alias("raw")).collect()
    out = np.zeros((2, BUCKETS), np.int64)
    for r in sums:  # BUCKETS rows
        out[:, r.chunk * size + r.slot] = r.target, r.raw
    return out[0], out[1]


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Per bucket log p(target) - log p(raw), smoothed alike in both models."""
    if not target.sum():
        return np.zeros(len(raw))
    p = (target + SMOOTHING) / (target.sum() + SMOOTHING * len(target))
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * len(raw))
    return np.log(p) - np.log(q)


def gumbel(doc_id: str, seed: int):
    """Standard Gumbel noise from 52 bits of md5 over the id and the seed."""
    text = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(f":{seed}"))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log(-F.log((bits + 0.5) / float(1 << 52)))


def weigh(docs: DataFrame, good: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, log_weight, key) of every document; texts without words weigh 0."""
    table_ = docs.sparkSession.sparkContext.broadcast(log_ratio(*bucket_counts(docs, good)))

    def run(batch):
        for rows, texts in text_slices(batch):
            found, n = features(_lowered(texts))
            sums = np.concatenate([[0.0], np.cumsum(table_.value[found])])
            edges = np.concatenate([[0], np.cumsum(n)])
            yield {"doc_id": rows.column("doc_id"), "n_features": n, "log_weight": sums[edges[1:]] - sums[edges[:-1]]}

    scored = map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_features long, log_weight double")
    return scored.withColumn("key", F.col("log_weight") + gumbel("doc_id", seed))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, log_weight, key) of the documents sampled.

    The target are the documents labelled with quality 1. ``share`` of all documents are sampled; by
    default the share of good ones among the labelled. Without a good label all weights are equal.
    Null texts count as empty; a document labelled twice is good if one label says so; labels without
    a document or with nulls are not used. Repeated rows and rows without an id are sampled together, as
    they have the same key. Ties go to the larger id.
    """
    usable = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sums = usable.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good")).first()
    if share is None:
        share = sums.good / sums.n if sums.n else 1.0
    weighed = stored(weigh(docs, usable.where("quality = 1").select("doc_id"), seed))
    # A double as a long in the same order.
    micro = F.round(F.greatest(F.least(F.col("key"), F.lit(9e11)), F.lit(-9e11)) * 1e6).cast("long")
    ordered = weighed.select("*", micro.alias("_order"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_tie"))
    k = math.ceil(share * weighed.count() - 1e-9)
    return largest(ordered, "_order", "_tie", k).drop("_order", "_tie")


def op3_importance_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
