"""Document fingerprints from closed syncmers.

A k-mer of characters is a closed syncmer if the smallest of its s-mers is the first or the last one.
That depends on the k-mer alone, so an edit changes only the anchors that touch it, and every
stretch of k-s+1 k-mers has one. A fingerprint keeps the anchors of smallest hash, which is a fixed
number however long the text is, with the place of each.

Two fingerprints are matched by position: of the smallest anchors of both together, those count
that both have in the same order, i.e. the longest run of common anchors whose places rise on both
sides. Likeness is their share, an estimate of the Jaccard similarity of the anchor sets in order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import NO_ID, table
from pairlens.llm.hashing import RangeHash, mix64
from pairlens.session import shuffle_partitions

K, S = 16, 5
#: Anchors of a fingerprint.
ANCHORS = 96
#: Share of a text, from its end, that the edited text has from the next document.
EDITED = 4
_SLICE_CHARS = 1 << 19


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts one after another, edges of the texts)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return flat, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have, out = 1, values
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(texts: list[str], k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, text) of all closed syncmers, in text order.

    A text shorter than k has one anchor, the whole of it; an empty one has none.
    """
    flat, edges = code_points(texts)
    lengths = np.diff(edges)
    hashes = RangeHash(mix64(flat.astype(np.uint64) + np.uint64(1)))
    found = []
    if len(flat) >= k:
        at = np.arange(len(flat) - s + 1)
        small = hashes.range(at, at + s)
        inner = k - s + 1
        least = _sliding_min(small, inner)
        n = len(least)
        start = np.arange(n)
        # A k-mer may not run over the end of its text.
        owner = np.repeat(np.arange(len(texts)), lengths)[:n]
        closed = (small[:n] == least) | (small[inner - 1 : inner - 1 + n] == least)
        closed &= start + k <= edges[owner + 1]
        start = start[closed]
        found.append((hashes.range(start, start + k, 2), start - edges[owner[closed]], owner[closed]))
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(short):
        found.append((hashes.range(edges[short], edges[short + 1], 3), np.zeros(len(short), np.int64), short))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    h, place, owner = (np.concatenate(x) for x in zip(*found))
    if len(found) > 1:
        order = np.argsort(owner, kind="stable")
        h, place, owner = h[order], place[order], owner[order]
    return h, place, owner


def fingerprints(texts: list[str], size: int = ANCHORS) -> list[list[tuple[int, int]]]:
    """Per text the (hash, place) of its anchors of smallest hash, by hash; a repeated anchor once."""
    h, at, owner = anchors(texts)
    h = h >> np.uint64(24)  # 40 bits
    total = np.bincount(owner, minlength=len(texts))
    # Hashes are even, so twice the wanted number lies below this; texts that come out short
    # (their anchors repeat) are taken whole.
    bound = (np.minimum(2 * size / np.maximum(total, 1), 1.0) * (1 << 40)).astype(np.uint64)
    out = _smallest(h, at, owner, h <= bound[owner], len(texts), size)
    poor = np.array([len(x) < size for x in out]) & (bound < np.uint64(1 << 40))
    if poor.any():
        again = _smallest(h, at, owner, poor[owner], len(texts), size)
        for k in np.flatnonzero(poor):
            out[k] = again[k]
    return out


def _smallest(h, at, owner, use: np.ndarray, texts: int, size: int) -> list[list[tuple[int, int]]]:
    h, at, owner = h[use], at[use], owner[use]
    order = np.lexsort((h, owner))  # keeps equal anchors in text order
    h, at, owner = h[order], at[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, at, owner = h[new], at[new], owner[new]
    edges = np.searchsorted(owner, np.arange(texts + 1))
    rank = np.arange(len(h)) - edges[owner]
    h, at, owner = h[rank < size], at[rank < size], owner[rank < size]
    edges = np.searchsorted(owner, np.arange(texts + 1)).tolist()
    pairs = list(zip(h.tolist(), at.tolist()))
    return [pairs[a:b] for a, b in zip(edges[:-1], edges[1:])]


def likeness(a: list[tuple[int, int]], b: list[tuple[int, int]], size: int = ANCHORS) -> float:
    """1 for equal fingerprints (two empty ones included), 0 without common anchors."""
    if a == b:
        return 1.0
    places = dict(b)
    union = sorted({h for h, _ in a} | places.keys())[:size]
    if not union:
        return 0.0
    last = union[-1]
    common = sorted((p, places[h]) for h, p in a if h <= last and h in places)
    tails: list[int] = []
    for _, q in common:
        k = bisect_left(tails, q)
        tails[k : k + 1] = [q]
    return len(tails) / len(union)


def to_text(print_: list[tuple[int, int]]) -> str:
    """Anchors by place: 10 hex digits of hash, a colon, the place; joined by commas."""
    return ",".join(f"{h:010x}:{p:x}" for h, p in sorted(print_, key=lambda x: (x[1], x[0])))


def from_text(text: str) -> list[tuple[int, int]]:
    return sorted((int(h, 16), int(p, 16)) for h, _, p in (x.partition(":") for x in text.split(",") if x))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in ranges of doc_id, sorted, each range ended by a guest row: the first of
    the next range, or the first of all after the last. Texts are shuffled once."""
    spark = docs.sparkSession
    doc = F.coalesce("doc_id", F.lit(NO_ID)).alias("doc")
    rows = docs.select(doc, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = shuffle_partitions(spark)
    # Edges of about even ranges: quantiles of the ids, at most one per partition.
    share = [k / parts for k in range(1, parts)]
    edges = rows.select(F.percentile_approx("doc", share, 100 * parts) if share else F.array()).first()[0] or []
    edges = sorted({int(e) for e in edges})
    part = F.array_size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<bigint>"), lambda e: e < F.col("doc")))
    firsts = {
        r.part: r.doc for r in rows.groupBy(part.alias("part")).agg(F.min("doc").alias("doc")).collect()
    }
    if not firsts:
        return rows.select("doc_id", "text", F.lit(0).alias("part"), F.lit(False).alias("guest"), "doc")
    order = sorted(firsts)
    host = {firsts[p]: order[k - 1] for k, p in enumerate(order)}  # the first range's host is the last
    hosts = F.create_map(*[F.lit(x) for e in host.items() for x in e])
    own = rows.select("*", part.alias("part"), F.lit(False).alias("guest"))
    guests = rows.where(F.col("doc").isin(list(host))).select(
        "*", hosts[F.col("doc")].alias("part"), F.lit(True).alias("guest")
    )
    return (
        own.unionByName(guests).repartition(parts, "part")
        .sortWithinPartitions("part", "guest", "doc", "text").select("doc_id", "text", "part", "guest", "doc")
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Null texts count as empty. The next document is that of the next larger doc_id, after the last
    the first; rows without doc_id come last, repeated rows follow one another by text. The only
    document is its own next.
    """

    def run(batches):
        held = None  # the last document of the range so far, waiting for its next
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            parts, guests = batch.column("part").to_pylist(), batch.column("guest").to_pylist()
            pairs = []
            for row in zip(ids, texts, parts, guests):
                if held is not None and held[2] == row[2]:
                    pairs.append((held[0], held[1], row[1]))
                # Of several rows with the first id only the first is a guest that counts.
                held = row if not row[3] else None
            lo = size = 0
            for hi, (_, text, following) in enumerate(pairs, 1):
                size += len(text) + len(following)
                if size >= _SLICE_CHARS or hi == len(pairs):
                    yield _fingerprinted(pairs[lo:hi])
                    lo, size = hi, 0

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return with_next(docs).mapInArrow(run, schema)


def _fingerprinted(pairs: list[tuple]) -> pa.RecordBatch:
    texts = [p[1] for p in pairs]
    edited = []
    for _, text, following in pairs:
        cut = len(text) // EDITED
        edited.append(text[: len(text) - cut] + following[:cut])
    # A row's next is mostly the row after it, so only a changed one is fingerprinted again.
    nexts = [p[2] for p in pairs]
    follows = [k + 1 < len(texts) and texts[k + 1] == nexts[k] for k in range(len(texts))]
    lone = [n for n, f in zip(nexts, follows) if not f]
    prints = fingerprints(texts + edited + lone)
    mine, other, rest = prints[: len(texts)], prints[len(texts) : 2 * len(texts)], iter(prints[2 * len(texts) :])
    after = [mine[k + 1] if f else next(rest) for k, f in enumerate(follows)]
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([p[0] for p in pairs], pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": [to_text(x) for x in mine],
        "edited_fingerprint": [to_text(x) for x in other],
        "near_edited": pa.array([likeness(x, y) for x, y in zip(mine, other)], pa.float64()),
        "near_next": pa.array([likeness(x, y) for x, y in zip(mine, after)], pa.float64()),
    })


def op6_syncmers(spark, sf_dir):
    return fingerprint_documents(table(spark, sf_dir, "documents"))
