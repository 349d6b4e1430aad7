"""Substring deduplication by recompression.

A document's words are renamed in rounds: a run of one symbol becomes a symbol, and so does a pair of
a left symbol and the right symbol after it, where a hash of the symbol and the round decides which
symbols are left and which are right. Names are hashes of what they replace, so a name means the
same words everywhere, and equal passages get equal symbols inside, whatever surrounds them.

Spark then names symbols globally, i.e. counts in which documents they occur:

1. High symbols that cover many words and occurred in an earlier document are long repeats as they
   stand: all their words go, and no window inside them needs a look.
2. Low symbols are known together with the words their formation depended on. A window that holds
   such a symbol whole can be a repeat only if the symbol occurs elsewhere too, so symbols of one
   document rule out nearly all windows.
3. The windows left are verified: their hashes (96 bits over the words themselves) are grouped, and
   a window is a repeat if its words occurred in an earlier document or earlier in its own.

A document contributes each symbol and window once, minima are aggregates with map-side combining,
and joins are plain equi-joins over stored tables, so hot passages are split like any skewed key.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import BROADCAST_IDS, NO_ID, list_array, listed, map_batches, stored, table, text_slices
from pairlens.llm.hashing import RangeHash, WordHashes, mix64, windows, words_of

#: Words of a window.
WINDOW = 20
#: Pair rounds after which low symbols are taken, and the fewest words of one.
LOW_ROUNDS, LOW_WORDS = 4, 3
#: Fewest words of a high symbol (a window at least), and the rounds they are sought in.
HIGH_WORDS, ROUNDS = 32, 48
#: What tells rows apart: their document and, where that has several, their text.
ROW = ["doc", "k1", "k2"]
_LEFT, _RIGHT, _RUN = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class Symbols(NamedTuple):
    """Symbols of several documents in order; [start, end) are words, [low, high) what they depend on."""

    name: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def joined(self, name: np.ndarray, first: np.ndarray, last: np.ndarray, low, high) -> "Symbols":
        return Symbols(name, self.doc[first], self.start[first], self.end[last], low, high)


def _same_doc(s: Symbols) -> np.ndarray:
    """Whether a symbol is in the document of the one before; False at both ends (n + 1 entries)."""
    out = np.zeros(len(s.doc) + 1, bool)
    out[1:-1] = s.doc[1:] == s.doc[:-1]
    return out


def _around(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """What knowing the left and the right neighbour depends on; past the document without one."""
    same = _same_doc(s)
    left = np.where(same[:-1], np.roll(s.low, 1), s.start - 1)
    right = np.where(same[1:], np.roll(s.high, -1), s.end + 1)
    return left, right


def name_runs(s: Symbols) -> Symbols:
    """Runs of one symbol become one symbol."""
    if not len(s.name):
        return s
    same = _same_doc(s)
    begins = np.ones(len(s.name), bool)
    begins[1:] = ~(same[1:-1] & (s.name[1:] == s.name[:-1]))
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(s.name)) - 1
    n = (last - first + 1).astype(np.uint64)
    left, right = _around(s)
    name = np.where(n > 1, mix64(s.name[first] + n * _RUN), s.name[first])
    return s.joined(name, first, last, left[first], right[last])


def name_pairs(s: Symbols, round_: int) -> tuple[Symbols, np.ndarray]:
    """A left symbol and a right one after it become one symbol; also which symbols are new."""
    if not len(s.name):
        return s, np.zeros(0, bool)
    same = _same_doc(s)
    is_left = mix64(s.name + np.uint64((round_ + 1) * int(_LEFT) & (1 << 64) - 1)) >> np.uint64(63) == 0
    opens = np.zeros(len(s.name), bool)
    opens[:-1] = is_left[:-1] & ~is_left[1:] & same[1:-1]
    closes = np.zeros(len(s.name), bool)
    closes[1:] = opens[:-1]
    left, right = _around(s)
    first = np.flatnonzero(~closes)
    paired = opens[first]
    last = first + paired
    name = np.where(
        paired, mix64(s.name[first] * _LEFT + s.name[last] * _RIGHT + np.uint64(1)), s.name[first]
    )
    # A pair depends on its two symbols only; a single one on the neighbour it did not pair with.
    low = np.where(~paired & ~is_left[first], left[first], s.low[first])
    high = np.where(~paired & is_left[first], right[first], s.high[last])
    return s.joined(name, first, last, low, high), paired


def word_symbols(words: WordHashes) -> Symbols:
    at = np.arange(len(words.starts))
    doc = np.repeat(np.arange(len(words.words_per_doc)), words.words_per_doc)
    return Symbols(words.words(), doc, at, at + 1, at, at + 1)


def low_symbols(s: Symbols) -> Symbols:
    s = name_runs(s)
    for r in range(LOW_ROUNDS):
        s, _ = name_pairs(s, r)
    return s


def informative(s: Symbols) -> np.ndarray:
    """Symbols that some window can hold with all that they depend on."""
    return (s.end - s.start >= LOW_WORDS) & (s.high - s.low <= WINDOW)


def high_symbols(s: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, document, start, end) of all symbols of at least ``HIGH_WORDS`` words above ``s``."""
    found = []
    for r in range(LOW_ROUNDS, ROUNDS):
        if not len(s.doc) or len(s.doc) == s.doc[-1] + 1 - s.doc[0]:
            break
        for step in (name_runs, lambda x: name_pairs(x, r)[0]):
            before, s = s, step(s)
            new = s.end - s.start >= HIGH_WORDS
            # A symbol is new if it covers more than the one that began there.
            new &= s.end > before.end[np.searchsorted(before.start, s.start)]
            found.append((s.name[new], s.doc[new], s.start[new], s.end[new]))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _once(doc: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Index of the first of each (document, name)."""
    order = np.lexsort((name, doc))
    new = np.ones(len(order), bool)
    new[1:] = (name[order][1:] != name[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    return order[new]


def _key(doc: np.ndarray, name: np.ndarray) -> np.ndarray:
    return mix64(name + doc.astype(np.uint64) * _RUN)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, k1, k2, text): doc orders the documents, and ``ROW`` tells different texts apart.

    k1 and k2 are a 128-bit hash of the text where rows of one doc differ in it, else 0, which
    costs the tables in between next to nothing.
    """
    doc = F.coalesce("doc_id", F.lit(NO_ID)).alias("doc")
    whole = docs.select("doc_id", doc, F.coalesce("text", F.lit("")).alias("text"))
    hashes = F.xxhash64("text"), F.xxhash64(F.lit(7), "text")
    ends = [f(h) for h in hashes for f in (F.min, F.max)]
    several = stored(
        whole.groupBy("doc").agg(*[e.alias(f"e{i}") for i, e in enumerate(ends)])
        .where("e0 <> e1 or e2 <> e3").select("doc", F.lit(True).alias("several"))
    )
    several = F.broadcast(several) if several.count() <= BROADCAST_IDS else several
    return whole.join(several, "doc", "left").select(
        "doc_id", "doc", *[F.when(F.col("several"), h).otherwise(F.lit(0)).alias(k) for k, h in zip(ROW[1:], hashes)], "text"
    )


def document_symbols(docs: DataFrame) -> DataFrame:
    """(name, doc, k1, k2): every low and high symbol of a text once."""

    def run(batch):
        for rows, texts in text_slices(batch):
            low = low_symbols(word_symbols(words_of(texts)))
            use = informative(low)
            name, doc, _, _ = high_symbols(low)
            name = np.concatenate([low.name[use], name])
            doc = np.concatenate([low.doc[use], doc])
            one = _once(doc, name)
            yield {
                "name": name[one].view(np.int64),
            } | {c: rows.column(c).take(pa.array(doc[one])) for c in ROW}

    return map_batches(docs.select(*ROW, "text"), run, "name long, doc long, k1 long, k2 long")


def _spread(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """How many of the ranges [start, end) cover each of ``size`` places."""
    steps = np.bincount(starts, minlength=size + 1)[: size + 1] - np.bincount(ends, minlength=size + 1)[: size + 1]
    return np.cumsum(steps)[:size]


def candidate_windows(flagged: DataFrame) -> DataFrame:
    """Per document its windows still in question, and the words already known to be repeats.

    ``flagged`` has (doc_id, doc, k1, k2, text, names, earlier): the symbols of the text that other
    documents have, and whether an earlier one does.
    """

    def run(batch):
        for rows, texts in text_slices(batch):
            words = words_of(texts)
            total, first = len(words.starts), words.first_word
            low = low_symbols(word_symbols(words))
            flags = rows.column("names")
            owner = np.repeat(np.arange(len(texts)), flags.value_lengths().fill_null(0).to_numpy())
            keys = _key(owner, flags.flatten().to_numpy().view(np.uint64))
            before = rows.column("earlier").flatten().to_numpy(zero_copy_only=False).astype(bool)
            # Windows holding a symbol that only this document has, and has once, are no repeats.
            use = informative(low)
            mine = _key(low.doc[use], low.name[use])
            values, at, count = np.unique(mine, return_inverse=True, return_counts=True)
            lone = (count == 1)[at] & ~np.isin(mine, keys)
            lows, highs, where = low.low[use][lone], low.high[use][lone], low.doc[use][lone]
            # Window starts high - WINDOW .. low are ruled out.
            ruled = _spread(np.maximum(highs - WINDOW, first[where]), lows + 1, total) > 0
            # High symbols seen in an earlier document, or earlier in this one.
            name, doc, start, end = high_symbols(low)
            own = _key(doc, name)
            repeat = np.isin(own, keys[before])
            again = np.ones(len(own), bool)
            order = np.lexsort((start, own))
            again[order] = np.append(False, own[order][1:] == own[order][:-1])[: len(own)]
            repeat |= again
            known = _spread(start[repeat], end[repeat], total) > 0
            inside = _spread(start[repeat], end[repeat] - WINDOW + 1, total) > 0
            begin, owner_of = windows(words, first, WINDOW)
            asked = ~ruled[begin] & ~inside[begin]
            begin, owner_of = begin[asked], owner_of[asked]
            h64 = RangeHash(words.words()).range(begin, begin + WINDOW)
            h32 = RangeHash(words.words(1)).range(begin, begin + WINDOW, 3) >> np.uint64(33)
            # Later equal windows of a document are repeats by themselves.
            once = np.zeros(len(begin), bool)
            once[_once(owner_of, h64)] = True
            late = _spread(begin[~once], begin[~once] + WINDOW, total) > 0
            known |= late
            begin, owner_of, h64, h32 = begin[once], owner_of[once], h64[once], h32[once]
            per_doc = np.bincount(owner_of, minlength=len(texts))
            edges = np.diff(np.concatenate([[0], known.astype(np.int8), [0]]))
            # Known words as ranges within a document.
            cuts = np.flatnonzero(edges)
            starts, ends = _split_ranges(cuts[::2], cuts[1::2], first)
            holder = np.searchsorted(first, starts, side="right") - 1
            ranges = np.stack([starts - first[holder], ends - first[holder]], 1).ravel().astype(np.int32)
            n_ranges = np.bincount(holder, minlength=len(texts))
            yield {
                "doc_id": rows.column("doc_id"), **{c: rows.column(c) for c in ROW},
                "n_words": words.words_per_doc,
                "whole_sha256": [hashlib.sha256(b" ".join(t.as_py().encode().split())).hexdigest() for t in texts],
                "h64": list_array(h64.view(np.int64), per_doc),
                "h32": list_array(h32.astype(np.int32), per_doc),
                "start": list_array((begin - first[owner_of]).astype(np.int32), per_doc),
                "known": list_array(ranges, 2 * n_ranges),
            }

    return map_batches(
        flagged, run,
        "doc_id long, doc long, k1 long, k2 long, n_words long, whole_sha256 string, "
        "h64 array<long>, h32 array<int>, start array<int>, known array<int>",
    )


def _split_ranges(starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges cut where a new document begins."""
    a = np.searchsorted(first, starts, side="right")
    b = np.searchsorted(first, ends, side="left")
    extra = np.concatenate([first[x:y] for x, y in zip(a, b)]) if len(a) and (b > a).any() else first[:0]
    extra = np.unique(extra)
    return np.sort(np.concatenate([starts, extra])), np.sort(np.concatenate([ends, extra]))


def _kept(text: str, known: np.ndarray, starts: np.ndarray) -> tuple[int, int, bytes]:
    """(number of words, of words removed, the others joined by one space)."""
    words = text.encode().split()  # on the six ASCII white-space bytes
    n = len(words)
    steps = np.zeros(n + 1, np.int64)
    for at, by in ((known[::2], 1), (known[1::2], -1), (starts, 1), (starts + WINDOW, -1)):
        np.add.at(steps, np.minimum(at, n), by)
    removed = np.cumsum(steps[:n]) > 0
    return n, int(removed.sum()), b" ".join([w for w, r in zip(words, removed.tolist()) if not r])


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]), one row per document.

    A word goes if some window of ``WINDOW`` words over it occurred before: in a document of smaller
    doc_id, or earlier in the same document. Null texts have no words; documents below one window keep
    all theirs. Rows without doc_id come after all others and count as one document, as do rows that
    repeat a doc_id: passages that only they share stay, and each row loses the words of its own text
    that an earlier document or that text itself had before. Equal rows get the same result each.
    Other columns are not read.
    """
    whole = keyed(docs)
    symbols = stored(document_symbols(whole))
    shared = stored(
        symbols.groupBy("name").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        .where("first < last").select("name", "first")
    )
    flags = (
        symbols.join(shared, "name").groupBy(*ROW)
        .agg(F.collect_list(F.struct("name", (F.col("first") < F.col("doc")).alias("earlier"))).alias("f"))
        .select(*ROW, F.col("f.name").alias("names"), F.col("f.earlier").alias("earlier"))
    )
    cases = stored(candidate_windows(whole.join(flags, ROW, "left").select("doc_id", *ROW, "text", "names", "earlier")))
    windows_of = cases.select(*ROW, F.explode(F.arrays_zip("h64", "h32", "start")).alias("w")).select(
        *ROW, "w.h64", "w.h32", "w.start"
    )
    seen = stored(
        windows_of.groupBy("h64", "h32").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        .where("first < last").select("h64", "h32", "first")
    )
    repeats = (
        windows_of.join(seen, ["h64", "h32"]).where("doc > first")
        .groupBy(*ROW).agg(F.collect_list("start").alias("starts"))
    )
    spans = stored(
        cases.select(*ROW, "known").join(repeats, ROW, "left").where("size(known) > 0 or starts is not null").distinct()
    )
    changed_ids = stored(spans.select(*ROW).distinct())
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def run(batch):
        rows = []
        for text, known, starts in zip(*(batch.column(c) for c in ("text", "known", "starts"))):
            ranges = (np.array(x.as_py() or [], np.int64) for x in (known, starts))
            rows.append(_kept(text.as_py(), *ranges))
        yield {
            "doc_id": batch.column("doc_id"), "n_words": [r[0] for r in rows],
            "n_removed": [r[1] for r in rows], "kept_sha256": [hashlib.sha256(r[2]).hexdigest() for r in rows],
        } | ({"kept": [r[2].decode() for r in rows]} if with_text else {})

    columns = "doc_id", "text", "known", "starts"
    if with_text:
        texts = whole.join(spans, ROW, "left")
        return map_batches(texts.select(*columns), run, schema + ", kept string")
    texts = whole.join(listed(changed_ids), ROW, "left_semi").join(spans, ROW)
    changed = map_batches(texts.select(*columns), run, schema)
    same = cases.join(listed(changed_ids), ROW, "left_anti").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("whole_sha256").alias("kept_sha256")
    )
    return changed.unionByName(same)


def op2_recompression(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
