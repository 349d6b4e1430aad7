"""Near-duplicate classes by Order MinHash, verified by banded alignment.

The k-mers of a document are its runs of five words, each labelled with how many times it occurred
before. A sketch takes the three k-mers of smallest hash and keeps them in text order, so documents
agree on a sketch only if they share those k-mers in the same order. Twenty sketches with hash
functions of their own are taken; at similarity 0.8 two documents miss all of them with a
probability below one in a million.

Equal texts are one vertex. Its key is the smallest doc_id of its rows with 62 bits of the text's hash
behind it, so rows that repeat a doc_id, or have none, with other texts are vertices of their own, and
the smallest key of a class holds its smallest doc_id. Documents that agree on a sketch form a bucket. Small buckets are
compared pairwise; in large ones every member is compared with the bucket's hub. While that leaves
members of several classes together, a member of the smallest class is the next hub of the same
bucket. Once hubs no longer halve the pairs of different classes, those members are dealt by a
condition that all pairs at the similarity meet: ordered from the rarest k-mer to the most common
one, two such documents share a k-mer among the first fifth of each. All pairs of different classes
that it leaves are compared, so every pair that agrees on a sketch is compared or in one class.

A candidate pair is verified by aligning the two sequences of k-mers inside the band that the
similarity allows, with bit-parallel rows. K-mers are made once per text and travel in pieces of
bounded size; pairs are sorted by one of their texts, so that a hub's k-mers come once for a run of
up to ``PAIRS_PER_HEAD`` pairs and not once per pair. Similarity is matched k-mers over all of both, i.e.
the Jaccard similarity of labelled five-word runs that the alignment keeps in order.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import NO_ID, class_labels, hub_order, list_array, listed, map_batches, stored, table, text_slices
from pairlens.llm.hashing import RangeHash, WordHashes, mix64, words_of

K, SIMILARITY = 5, 0.8
SKETCHES, PER_SKETCH = 20, 3
#: Buckets up to this size are compared pairwise.
SMALL_BUCKET = 8
#: So many pairs of different classes per row of all buckets are expanded even from large buckets.
PAIRS_PER_ROW = 1
#: Longs of 64 bits in which a text's k-mers are noted, to tell texts apart before they are paired.
NOTES = 16
#: So many of a text's rarest k-mers travel with the later ones, to tell whether a pair has met before.
LEAD = 32
#: K-mers of one row on their way to verification, and pairs that share one copy of a hub's k-mers.
PIECE, PAIRS_PER_HEAD = 1024, 256
_HASH_VALUES = 1 << 62
_RNG = np.random.default_rng(11)
_ODD = _RNG.integers(1 << 62, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _RNG.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)
_PLACE = _RNG.integers(1 << 62, 1 << 63, PER_SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: WordHashes, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of k words in text order, number of them per text).

    A text of fewer than k words has one run of all its words, a text without words none.
    """
    per_doc = words.words_per_doc
    n = np.where(per_doc >= k, per_doc - k + 1, (per_doc > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), n)
    first = words.first_word
    start = first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    end = np.minimum(start + k, first[1:][doc])
    return RangeHash(words.words()).range(start, end), n


def labelled(runs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each run hashed together with the number of equal ones before it in its text."""
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((runs, doc))
    new = np.ones(len(runs), bool)
    new[1:] = (runs[order][1:] != runs[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = np.arange(len(runs))
    seen = np.empty(len(runs), np.uint64)
    seen[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix64(runs + seen * np.uint64(0xA0761D6478BD642F))


def order_sketches(kmers: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One row of sketches per text that has k-mers, in order."""
    out = np.empty((int((n > 0).sum()), SKETCHES), np.uint64)
    row, lo = 0, 0
    for size in n[n > 0].tolist():
        own = kmers[lo : lo + size]
        lo += size
        if size > PER_SKETCH:
            keyed = (own[None, :] ^ _SALT[:, None]) * _ODD[:, None]
            least = np.argpartition(keyed, PER_SKETCH - 1, axis=1)[:, :PER_SKETCH]
            least.sort(axis=1)
            picked = own[least]
        else:
            picked = np.broadcast_to(own, (SKETCHES, size))
        out[row] = mix64((picked * _PLACE[: picked.shape[1]]).sum(axis=1, dtype=np.uint64))
        row += 1
    return mix64(out + np.arange(SKETCHES, dtype=np.uint64))


def aligned_matches(a: list, b: list, band: int, need: int) -> int:
    """Length of the longest common subsequence of a and b that keeps within ``band`` of the
    diagonal; may stop early with less than ``need`` when that cannot be reached any more.

    A row of the alignment is one integer: bit j is 0 where the row grows at column ``low + j``.
    The window of 2 * band + 1 columns moves one column to the right with every row.
    """
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    found = head + tail
    if not a or not b:
        return found
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    width = 2 * band + 1
    full = (1 << width) - 1
    low, row, passed = -band, full, 0  # columns low .. low + width - 1
    for i, x in enumerate(a):
        mask = 0
        if x in places:
            at = places[x]
            for j in at[bisect_left(at, max(low, 0)) :]:
                if j >= low + width:
                    break
                mask |= 1 << (j - low)
        if mask:
            hit = row & mask
            row = ((row + hit) | (row & ~mask)) & full
        if i + 1 < len(a):
            passed += not row & 1
            row = (row >> 1) | (1 << (width - 1))
            low += 1
        if not i & 63 and found + passed + width - row.bit_count() + len(a) - 1 - i < need:
            break
    return found + passed + width - row.bit_count()


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> tuple[bool, int]:
    """(whether the aligned similarity is reached, matched k-mers); without k-mers never."""
    total = len(a) + len(b)
    need = math.ceil(similarity * total / (1 + similarity) - 1e-9)
    if not total or min(len(a), len(b)) < need:
        return False, 0
    one, two = np.sort(a), np.sort(b)
    at = np.searchsorted(two, one, "right") - np.searchsorted(two, one, "left")
    if np.count_nonzero(at) < need:  # a bound: more than this cannot match
        return False, 0
    found = aligned_matches(a.tolist(), b.tolist(), total - 2 * need, need)
    return found >= need, found


def vertex_key(doc_id: Column, h1: Column) -> Column:
    """doc_id (after all others, where there is none) and 62 bits of the text's hash in one decimal."""
    doc = F.coalesce(doc_id, F.lit(NO_ID)).cast("decimal(38,0)")
    values = F.lit(_HASH_VALUES).cast("decimal(38,0)")
    return (doc * values + F.pmod(h1, F.lit(_HASH_VALUES)).cast("decimal(38,0)")).cast("decimal(38,0)")


def key_doc(key: Column) -> Column:
    """The doc_id of a vertex key, ``NO_ID`` for none."""
    values = F.lit(_HASH_VALUES).cast("decimal(38,0)")
    return F.call_function("div", key - F.pmod(key, values), values)


def _text_hash(words: WordHashes) -> np.ndarray:
    lo, hi = words.first_word[:-1], words.first_word[1:]
    whole = RangeHash(words.words()).range(lo, hi)
    return mix64(whole + words.words_per_doc.astype(np.uint64)).astype(np.int64)


def sketch_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, h1, h2, n, sketches): a hash of the text as it stands, two of its word
    sequence, its k-mers and their sketches."""

    def run(batch):
        for rows, texts in text_slices(batch):
            words = words_of(texts)
            runs, n = shingles(words)
            kmers = labelled(runs, n)
            lo, hi = words.first_word[:-1], words.first_word[1:]
            size = words.words_per_doc.astype(np.uint64)
            rows_of_sketches = order_sketches(kmers, n).astype(np.int64)
            yield {
                "doc_id": rows.column("doc_id"),
                "text_hash": rows.column("text_hash"),
                "h1": _text_hash(words),
                "h2": mix64(RangeHash(words.words(1)).range(lo, hi, 3) + size).astype(np.int64),
                "n": n,
                "sketches": list_array(rows_of_sketches.ravel(), SKETCHES * (n > 0)),
            }

    return map_batches(
        docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), run,
        "doc_id long, text_hash long, h1 long, h2 long, n long, sketches array<long>",
    )


def kmers_of(keys: DataFrame, docs: DataFrame, labels: bool) -> DataFrame:
    """(rep, n, piece, kmers) of the vertices in column ``rep``, in pieces of at most ``PIECE`` k-mers.

    With ``labels`` k-mers are labelled by their number among equal ones. Rows that repeat a doc_id
    and its text come once.
    """
    keys = stored(keys.select("rep").distinct())
    ids = stored(keys.select(key_doc(F.col("rep")).alias("doc")).distinct())
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text").join(listed(ids), "doc", "left_semi")

    def run(batch):
        for rows, texts in text_slices(batch):
            words = words_of(texts)
            runs, n = shingles(words)
            values = labelled(runs, n) if labels else runs
            pieces = -(-n // PIECE)
            owner = np.repeat(np.arange(len(n)), pieces)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            yield {
                "doc": rows.column("doc").take(pa.array(owner)), "h1": _text_hash(words)[owner], "n": n[owner], "piece": number,
                "kmers": list_array(values.astype(np.int64), np.minimum(n[owner] - number * PIECE, PIECE)),
            }

    made = map_batches(texts, run, "doc long, h1 long, n long, piece int, kmers array<long>")
    made = made.select(vertex_key(F.col("doc"), F.col("h1")).alias("rep"), "n", "piece", "kmers")
    return made.join(listed(keys), "rep", "left_semi").dropDuplicates(["rep", "piece"])


def verify(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(a, b, ok) for candidate pairs of vertices."""
    pieces = stored(kmers_of(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")), docs, labels=False))
    heads = pairs.groupBy(F.col("a").alias("head")).agg(F.count(F.lit(1)).alias("n"))
    heads = stored(heads.where(F.col("n") > PAIRS_PER_HEAD).select("head", F.ceil(F.col("n") / PAIRS_PER_HEAD).alias("parts")))
    many = F.broadcast(heads) if heads.count() <= 100_000 else heads
    dealt = pairs.join(many, pairs["a"] == many["head"], "left").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    )
    of = lambda c: pieces.select(F.col("rep").alias(c), "piece", "kmers")
    first = dealt.select("a", "part").distinct().join(of("a"), "a").select("a", "part", F.lit(None).cast("decimal(38,0)").alias("b"), "piece", "kmers")
    rows = first.unionByName(dealt.join(of("b"), "b").select("a", "part", "b", "piece", "kmers"))
    # The text a of a run of pairs comes first (no b), then each b in turn.
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "b", "piece")

    def run(batches):
        head = tail = None
        held: dict[bool, list] = {False: [], True: []}
        done: list[tuple] = []

        def close():
            if tail is not None:
                one, two = (np.concatenate(held[k]) for k in (False, True))
                done.append((head[0], tail, alike(one, two, similarity)[0]))

        for batch in batches:
            lists = batch.column("kmers")
            cuts, values = np.asarray(lists.offsets), np.asarray(lists.values)
            keys = zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b")))
            for k, (a, part, b) in enumerate(keys):
                if (a, part) != head or b != tail:
                    close()
                    tail, held[True] = b, []
                    if (a, part) != head:
                        head, held[False] = (a, part), []
                held[b is not None].append(values[cuts[k] : cuts[k + 1]].copy())
            yield _checked(done)
            done.clear()
        close()
        yield _checked(done)

    return rows.mapInArrow(run, "a decimal(38,0), b decimal(38,0), ok boolean")


def _checked(rows: list[tuple]) -> pa.RecordBatch:
    key = pa.decimal128(38, 0)
    columns = zip(*rows) if rows else ((), (), ())
    arrays = [pa.array(c, kind) for c, kind in zip(columns, (key, key, pa.bool_()))]
    return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "ok"])


def noted(kmers: DataFrame) -> DataFrame:
    """(rep, notes): for every bit whether the number of k-mers that fall on it is odd."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("kmer", 32).bitwiseAND(63).cast("int"))
    longs = [F.bit_xor(F.when(F.col("kmer").bitwiseAND(NOTES - 1) == i, bit).otherwise(F.lit(0).cast("long"))) for i in range(NOTES)]
    return kmers.groupBy("rep").agg(F.struct(*[x.alias(f"w{i}") for i, x in enumerate(longs)]).alias("notes"))


def prefix_pairs(members: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of different classes of ``members`` (rep, label) that may be alike.

    Texts of n and m k-mers that are alike have at least similarity * max(n, m) of them in common.
    In any order of all k-mers the first common one thus has at most (1 - similarity) * n before it
    in one text and (1 - similarity) * m in the other. The rarest come first, so a passage that all
    members have brings no pairs. k-mers of one text only are counted but not joined.

    A pair that meets is kept only if it may be alike by its notes: every bit in which they differ
    stands for a k-mer that one of both texts lacks, and alike texts have few of those. From the first
    common k-mer on, both texts must have as many as the pair needs. A pair is left out where it has
    met before, in a k-mer among the ``LEAD`` rarest of both.
    """
    members = stored(members)
    whole = stored(kmers_of(members, docs, labels=True))
    kmers = whole.select("rep", "n", F.explode("kmers").alias("kmer"))
    shared = kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    common = F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-6))
    first = (kmers.join(shared, "kmer").groupBy("rep", "n")
             .agg(F.sort_array(F.collect_list(F.struct("texts", "kmer"))).alias("known"))
             .withColumn("take", (F.size("known") - common + 1).cast("int")).where("take > 0")
             .select("rep", "n", F.size("known").alias("size"), F.transform(F.slice("known", 1, LEAD), lambda k: k["kmer"]).alias("lead"),
                     F.posexplode(F.slice("known", F.lit(1), F.col("take"))).alias("at", "k")))
    before = F.slice("lead", F.lit(1), F.least(F.col("at"), F.lit(LEAD))).alias("before")
    room = (F.col("size") - F.col("at")).alias("room")
    placed = stored(first.select("rep", "n", "k.kmer", room, before).distinct().join(members, "rep"))
    notes = stored(noted(kmers.join(placed.select("rep").distinct(), "rep", "left_semi")))
    per_class = placed.groupBy("kmer", "label").agg(F.count(F.lit(1)).alias("members"))
    # No pair is within the largest class, so only the others look for partners.
    mixed = stored(
        per_class.groupBy("kmer").agg(F.max_by("label", F.struct("members", "label")).alias("most"), F.count(F.lit(1)).alias("classes"))
        .where("classes > 1").select("kmer", "most")
    )
    held = placed.join(mixed, "kmer").join(notes, "rep")
    left = held.where("label <> most").select(
        "kmer", F.col("rep").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"),
        F.col("notes").alias("wa"), F.col("before").alias("before_a"), F.col("room").alias("ra"),
    )
    right = held.select(
        "kmer", "most", F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"),
        F.col("notes").alias("wb"), F.col("before").alias("before_b"), F.col("room").alias("rb"),
    )
    apart = sum((F.bit_count(F.col(f"wa.w{i}").bitwiseXOR(F.col(f"wb.w{i}"))) for i in range(NOTES)), F.lit(0))
    lacking = (F.col("na") + F.col("nb")) * F.lit((1 - similarity) / (1 + similarity))
    met = left.join(right, "kmer").where("la <> lb and (lb = most or a < b)").where(
        (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity) - F.lit(1e-6)) & (apart <= lacking + F.lit(1e-6))
        & (F.least("ra", "rb") >= (F.col("na") + F.col("nb")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6))
        & ~F.arrays_overlap("before_a", "before_b")
    )
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(vertices: DataFrame, docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(verified pairs (a, b), labels) that connect every class of (rep, copies, sketches)."""
    found = tested = rows = pairs_left = None
    order = hub_order("weight", "rep")
    active = vertices.select(
        "rep", F.col("rep").alias("label"), F.col("copies").alias("weight"), F.posexplode("sketches").alias("band", "key")
    )
    for level in count():
        # The hub of a bucket is its most copied text, later a text of the smallest class.
        if level == 0:
            n = F.count(F.lit(1))
            each = active.groupBy("band", "key").agg(
                n.alias("size"), (n * (n - 1) / 2).alias("pairs"), F.max_by("rep", order).alias("hub")
            )
            each = each.where("size > 1").withColumn("hub_label", F.col("hub"))
        else:
            per_class = active.groupBy("band", "key", "label").agg(
                F.count(F.lit(1)).alias("n"), F.max_by("rep", order).alias("rep"), F.max("weight").alias("weight")
            )
            size = F.sum("n")
            each = per_class.groupBy("band", "key").agg(
                size.alias("size"), ((size * size - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"),
                F.max_by("rep", order).alias("hub"), F.max_by("label", order).alias("hub_label"),
            ).where("pairs > 0")
        buckets = stored(each)
        expand = F.col("size") <= SMALL_BUCKET
        sums = buckets.agg(
            F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.when(~expand, F.col("pairs"))), F.lit(0.0))
        ).first()
        rows = sums[0] if level == 0 else rows
        # Where the pairs left in large buckets are no more than the rows dealt, they are all taken.
        every = sums[1] <= PAIRS_PER_ROW * rows
        expand = F.lit(True) if every else expand
        # Where the last hubs have not halved them, those that k-mers allow are taken.
        last = every or level > 0 and sums[1] > pairs_left / 2
        pairs_left = sums[1]
        left = active.join(buckets.where(expand).select("band", "key"), ["band", "key"]).select(
            "band", "key", F.col("rep").alias("a"), F.col("label").alias("label_a")
        )
        right = left.withColumnsRenamed({"a": "b", "label_a": "label_b"})
        within = left.join(right, ["band", "key"]).where("a < b and label_a <> label_b").select("a", "b")
        large = active.join(buckets.where(~expand), ["band", "key"])
        if every:
            pairs = within
        elif last:
            pairs = within.union(prefix_pairs(large.select("rep", "label").distinct(), docs, similarity))
        else:
            large = large.where("label <> hub_label")
            pairs = within.union(large.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        checked = stored(verify(stored(pairs), docs, similarity))
        tested = checked if tested is None else stored(tested.unionByName(checked))
        found = tested.where("ok").select("a", "b")
        labels = class_labels(found)
        if last:
            break
        # Members of large buckets other than the hub stay in them, unless all are in one class.
        sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
        known = stored(labels.join(sizes, "label").withColumnRenamed("id", "rep"))
        again = (
            active.select("rep", "band", "key").join(buckets.where(~expand).select("band", "key", "hub"), ["band", "key"])
            .join(known, "rep", "left")
            .select(
                "rep", "band", "key", "hub", F.coalesce("label", "rep").alias("label"),
                (-F.coalesce("members", F.lit(1))).alias("weight"),
            )
        )
        again = stored(again)
        mixed = again.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        mixed = stored(mixed.where("low < high").select("band", "key"))
        if mixed.isEmpty():
            break
        active = stored(
            again.join(mixed, ["band", "key"]).where("rep <> hub").select("rep", "label", "weight", "band", "key")
        )
    return found, labels


def vertices_of(sketched: DataFrame) -> DataFrame:
    """(h1, h2, rep, copies, sketches) of every distinct text."""
    first = F.min_by(F.struct("n", "sketches"), F.coalesce("doc_id", F.lit(NO_ID))).alias("first")
    groups = sketched.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"), first)
    return groups.select("h1", "h2", vertex_key(F.col("doc"), F.col("h1")).alias("rep"), "copies", "first.sketches")


def _classed(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, text_hash, h1, rep, label) of every row with a text."""
    texts = docs.select("doc_id", "text").where("text is not null")
    sketched = stored(sketch_documents(texts))
    groups = stored(vertices_of(sketched))
    _, labels = links(groups.select("rep", "copies", "sketches"), texts, similarity)
    classes = groups.select("h1", "h2", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    classes = stored(classes.select("h1", "h2", "rep", F.coalesce("label", "rep").alias("label")))
    return sketched.select("doc_id", "text_hash", "h1", "h2").join(classes, ["h1", "h2"])


def _doc_or_null(key: Column) -> Column:
    doc = key_doc(key)
    return F.when(doc < NO_ID, doc)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, copy_of, class_id), one row per row of ``docs``.

    ``copy_of`` is the smallest doc_id with the same words, ``class_id`` the smallest of all
    documents connected by pairs of at least ``similarity``. Texts without words are copies of one
    another; null texts are copies of nothing and stand alone. Rows without doc_id take part like
    all others, after them in the order; a class of such rows only has no id. Rows that repeat a
    doc_id with another text are told apart by it and may be of different classes. Repeated rows
    stay repeated. Texts of any length are compared whole. Ties cannot occur. No rows give no rows.
    Other columns are not read.
    """
    known = _classed(docs, similarity).select(
        "doc_id", _doc_or_null(F.col("rep")).alias("copy_of"), _doc_or_null(F.col("label")).alias("class_id")
    )
    alone = docs.where("text is null").select("doc_id", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"))
    return known.unionByName(alone)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents of a class but for its first text by doc_id.

    A row goes if its doc_id or its words are not those of the class's first text. Rows that repeat
    both all stay, as do rows with null text and rows without doc_id, which nothing can name. All
    columns stay, whatever their names.
    """
    dropped = (
        _classed(docs, similarity)
        .where("doc_id is not null").where(vertex_key(F.col("doc_id"), F.col("h1")) != F.col("label"))
        .select(F.col("doc_id").alias("_dropped_id"), F.col("text_hash").alias("_dropped_text")).distinct()
    )
    dropped = listed(stored(dropped))
    same = (F.col("doc_id") == F.col("_dropped_id")) & (F.xxhash64("text") == F.col("_dropped_text"))
    return docs.join(dropped, same, "left_anti")


def op1_order_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
