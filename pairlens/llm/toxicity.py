"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its hashed byte n-grams (with word ends marked) and of the
word itself, so a misspelling shares most of its vectors with the word it hides. Words are averaged
over short spans, and a softmax over the span's average gives its probability; a document is as
toxic as its worst span. Averaging over a whole document would drown a single insult in a long text.

Training is fitted on a bounded sample of labelled rows in one task; texts never reach the driver,
which only gets the model. Scoring is linear in the embeddings, so the fitted model is one number per
n-gram bucket, and documents are scored in arrow batches wherever they lie, without a shuffle.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import map_batches, table, text_slices
from pairlens.llm.hashing import WordHashes, mix64, words_of

#: Largest number of labelled rows per class that the model is fitted on.
ROWS_PER_CLASS = 2500
#: Hash buckets and embedding width; n-gram lengths in bytes; words per span.
BUCKETS, WIDTH, GRAMS, SPAN = 1 << 18, 8, (3, 4, 5), 8
EPOCHS, WHOLE_EPOCHS, BATCH, RATE, SEED = 8, 3, 128, 0.1, 5
#: n-grams in fewer (document, word) pairs of the sample are left out.
LEAST_SEEN = 10
HELD_OUT_MODULUS = 5


@dataclass
class Model:
    """One number per bucket (the difference of the two classes' logits) and the bias."""

    bucket: np.ndarray
    bias: float


def held_out(doc_id="doc_id"):
    """True where crc32 of the id's text is divisible by 5: rows never learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(HELD_OUT_MODULUS)) == 0


def lowered(texts) -> list[bytes]:
    """Texts (strings, bytes or an arrow array) in lower case, the same for training and scoring."""
    if isinstance(texts, pa.Array):
        texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()
    return [(t if isinstance(t, str) else t.decode("utf-8", "replace")).lower().encode() for t in texts]


def subwords(hashes: WordHashes, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams of the given words in their order, number of them per word).

    A word's whole-word feature comes first. n-grams run over the word with one marker at each
    end: the marker is part of the hash of n-grams that touch that end.
    """
    starts, ends = hashes.starts[words], hashes.ends[words]
    length = ends - starts
    counts = np.ones(len(starts), np.int64)
    per_gram = []
    for n in GRAMS:
        # Of the marked word <w>, with length + 2 symbols.
        here = np.maximum(length + 2 - n + 1, 0)
        per_gram.append(here)
        counts += here
    first = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)
    out[first] = (hashes.range(starts, ends, 1) & np.uint64(BUCKETS - 1)).astype(np.int64)
    at = first + 1
    for n, here in zip(GRAMS, per_gram):
        owner = np.repeat(np.arange(len(starts)), here)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(here) - here, here)
        # Symbols k..k+n of <w> are bytes k-1..k+n-1 of w.
        lo = np.maximum(starts[owner] + k - 1, starts[owner])
        hi = np.minimum(starts[owner] + k - 1 + n, ends[owner])
        mark = np.uint64(2) + (k == 0).astype(np.uint64) + 2 * (k == here[owner] - 1).astype(np.uint64)
        out[at[owner] + k] = (
            mix64(hashes.range(lo, hi, n) + mark * np.uint64(0xD6E8FEB86659FD93)) & np.uint64(BUCKETS - 1)
        ).astype(np.int64)
        at = at + here
    return out, counts


def _spans(words_per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of every span, document of every span); empty documents have none."""
    n = -(-words_per_doc // SPAN)
    doc = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(words_per_doc) - words_per_doc)[doc] + k * SPAN, doc


def _word_means(values: np.ndarray, refs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values[refs], np.cumsum(counts) - counts) / counts


def _span_means(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    size = np.diff(np.append(first, len(words)))
    return np.add.reduceat(words, first) / size


def _worst(doc: np.ndarray, logit: np.ndarray, docs: int) -> np.ndarray:
    """Index of the span of largest logit per document, -1 without spans."""
    order = np.lexsort((logit, doc))
    last = np.full(docs, -1, np.int64)
    last[doc[order]] = order
    return last


class _Batch:
    """Some training documents: distinct words with their n-grams, and where they stand."""

    def __init__(self, texts: list[str]):
        hashes = words_of(lowered(texts))
        _, one, which = np.unique(hashes.words(), return_index=True, return_inverse=True)
        refs, self.counts = subwords(hashes, one)
        self.first, self.doc = _spans(hashes.words_per_doc)
        # All batches are held at once.
        self.which, self.refs = which.astype(np.int32), refs.astype(np.int32)
        self.per_doc = hashes.words_per_doc
        self.words = len(self.which)

    def seen(self) -> np.ndarray:
        """Per bucket the number of (document, word) it occurs in."""
        owner = np.repeat(np.arange(len(self.per_doc)), self.per_doc)
        pairs = np.unique(owner * np.int64(len(self.counts) + 1) + self.which)
        documents = np.bincount(pairs % (len(self.counts) + 1), minlength=len(self.counts))
        return np.bincount(self.refs, np.repeat(documents, self.counts), BUCKETS)

    def shares(self, line: np.ndarray, worst_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word positions, document and weight of each) that make up every document's vector."""
        if not worst_only:
            owner = np.repeat(np.arange(len(self.per_doc)), self.per_doc)
            return np.arange(self.words), owner, 1.0 / self.per_doc[owner]
        logit = _span_means(_word_means(line, self.refs, self.counts)[self.which], self.first)
        span = _worst(self.doc, logit, len(self.per_doc))
        owner = np.flatnonzero(span >= 0)
        end = np.append(self.first, self.words)
        span = span[owner]
        size = end[span + 1] - end[span]
        at = np.repeat(end[span] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return at, np.repeat(owner, size), np.repeat(1.0 / size, size)

    def parts(self, line: np.ndarray, worst_only: bool):
        """(n-grams, their number per word, word and document and weight of each position)."""
        at, owner, share = self.shares(line, worst_only)
        words, which = np.unique(self.which[at], return_inverse=True)
        counts = self.counts[words]
        first = (np.cumsum(self.counts) - self.counts)[words]
        refs = self.refs[np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        return refs, counts, which, owner, share

    def vectors(self, emb: np.ndarray, refs, counts, which, owner, share) -> np.ndarray:
        words = np.add.reduceat(emb[refs], np.cumsum(counts) - counts) / counts[:, None]
        picked = words[which] * share[:, None]
        return np.stack(
            [np.bincount(owner, picked[:, d], len(self.per_doc)) for d in range(emb.shape[1])], 1
        )

    @staticmethod
    def gradient(gv: np.ndarray, refs, counts, which, owner, share) -> tuple[np.ndarray, np.ndarray]:
        """(buckets touched, gradient of each) from the gradients of the document vectors."""
        out = np.empty((BUCKETS, gv.shape[1]), np.float32)
        for d in range(gv.shape[1]):
            word = np.bincount(which, gv[owner, d] * share, len(counts)) / counts
            out[:, d] = np.bincount(refs, np.repeat(word, counts), BUCKETS)
        used = np.flatnonzero(out.any(1))
        return used, out[used]


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """Embeddings and softmax fitted together by AdaGrad.

    The first epochs average whole documents, which finds the words that matter; the others
    average the worst span of each, which is what scoring does. n-grams seen fewer than
    ``LEAST_SEEN`` times keep a zero vector, so that a document's own words are not learned.
    """
    rng = np.random.default_rng(SEED)
    batches = [_Batch(texts[lo : lo + BATCH]) for lo in range(0, len(texts), BATCH)]
    seen = sum((b.seen() for b in batches if b.words), np.zeros(BUCKETS))
    learned = seen >= LEAST_SEEN
    emb = (rng.normal(0, 0.1, (BUCKETS, WIDTH)) * learned[:, None]).astype(np.float32)
    top = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    rate = np.average(toxic, weights=weight) if len(toxic) else 0.5
    bias = np.log(np.clip([1 - rate, rate], 1e-6, 1))
    sums = np.full(BUCKETS, 1e-12), np.full((WIDTH, 2), 1e-12), np.full(2, 1e-12)
    for epoch in range(EPOCHS):
        for b in rng.permutation(len(batches)):
            batch = batches[b]
            if not batch.words:
                continue
            y = toxic[b * BATCH : (b + 1) * BATCH].astype(int)
            w = weight[b * BATCH : (b + 1) * BATCH]
            parts = batch.parts(emb @ (top[:, 1] - top[:, 0]), epoch >= WHOLE_EPOCHS)
            vec = batch.vectors(emb, *parts)
            z = vec @ top + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            g = p * (w / weight.mean() / len(y))[:, None]
            used, grad = batch.gradient(g @ top.T, *parts)
            grad *= learned[used][:, None]
            sums[0][used] += (grad**2).mean(1)
            emb[used] -= (RATE * grad / np.sqrt(sums[0][used])[:, None]).astype(np.float32)
            gt, gb = vec.T @ g, g.sum(0)
            sums[1][:] += gt**2
            sums[2][:] += gb**2
            top -= (RATE * gt / np.sqrt(sums[1])).astype(np.float32)
            bias = bias - RATE * gb / np.sqrt(sums[2])
    return Model((emb @ (top[:, 1] - top[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def scores(model: Model, texts) -> np.ndarray:
    """Probability of toxic per text in lower case; texts without words get that of the bias alone."""
    hashes = words_of(lowered(texts))
    docs = len(hashes.words_per_doc)
    logit = np.zeros(docs)
    if len(hashes.starts):
        _, one, which = np.unique(hashes.words(), return_index=True, return_inverse=True)
        refs, counts = subwords(hashes, one)
        first, doc = _spans(hashes.words_per_doc)
        spans = _span_means(_word_means(model.bucket, refs, counts)[which], first)
        worst = np.full(docs, -np.inf)
        np.maximum.at(worst, doc, spans)
        logit = np.where(np.isfinite(worst), worst, 0.0)
    return 1 / (1 + np.exp(-np.clip(logit + model.bias, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Fit on at most ``rows_per_class`` labelled rows of each class, the ones of smallest hash.

    Rows with a null label or id, labels without a document and held-out rows are not used; a
    document labelled twice counts with its larger label. The classes are weighted back to their
    true share. Without labelled rows every document scores as if it were not toxic.
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    totals = {int(r.toxic): r.n for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for toxic in totals:
        part = usable.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None or not totals.get(1):
        return Model(np.zeros(BUCKETS, np.float32), -5.0)
    # At most 2 * rows_per_class ids: small by the bound above.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column("text").fill_null("").to_pylist()
            toxic += batch.column("toxic").to_pylist()
        model = _fitted(texts, np.array(toxic, np.int64), totals)
        del texts
        _give_back()
        yield pa.RecordBatch.from_pydict({"bucket": [model.bucket.tobytes()], "bias": [model.bias]})

    # The sample is bounded, and so is its one task; the driver gets the model and no texts.
    sample = rows.repartition(1).sortWithinPartitions("doc_id").select("text", F.col("toxic").cast("long").alias("toxic"))
    fitted = sample.mapInArrow(run, "bucket binary, bias double").collect()
    if not fitted:
        return _fitted([], np.zeros(0, np.int64), totals)
    return Model(np.frombuffer(bytes(fitted[0].bucket), np.float32), fitted[0].bias)


def _give_back() -> None:
    """Returns freed memory, which a worker that is used again would hold on to."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def _fitted(texts: list[str], toxic: np.ndarray, totals: dict[int, int]) -> Model:
    """The model of sampled texts in order of their ids; ``totals`` has the labelled rows of each class."""
    found = {c: max(1, int((toxic == c).sum())) for c in (0, 1)}
    weight = np.where(toxic == 1, totals[1] / found[1], totals.get(0, 0) / found[0])
    order = np.random.default_rng(SEED).permutation(len(toxic))
    return train([texts[i] for i in order], toxic[order], weight[order])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from 0.5 on); null texts score as empty ones.

    Keeps all columns and rows; a column of the same name is replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")
    names = kept.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batch):
        for rows, texts in text_slices(batch):
            p = scores(shared.value, texts)
            yield {n: rows.column(n) for n in names} | {
                "score": p, "predicted": (p >= 0.5).astype(np.int32)
            }

    return map_batches(kept, run, f"{kinds}, score double, predicted int")


def op8_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_documents(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
