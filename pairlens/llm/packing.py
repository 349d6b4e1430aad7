"""Best-fit decreasing packing of token pieces with a segment tree over remaining capacities.

Lengths are integers up to the capacity, so best-fit decreasing over any number of pieces needs only
their histogram: pieces of one length are alike, and so are open bins with the same room. The driver
walks the lengths from the longest down; a segment tree over the possible rooms finds the tightest
room that still takes the length in logarithmic time, and a whole run of bins with that room is
filled at once. The result is a list of moves, each handing a run of ranks within one length to a
run of bins. Its size depends on the capacity and not on the corpus. Spark ranks the pieces within
their length in hash buckets and each piece looks up its move. So the packing is one global
best-fit decreasing, not one per partition.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.llm.common import map_batches, stored, table, text_bytes, text_slices
from pairlens.session import shuffle_partitions

CAPACITY = 2048
#: Id that ends every document.
END_ID = 0
#: Words whose ids a worker remembers; past that it starts anew.
CACHED_WORDS = 1_000_000
#: Unknown words encoded in one call.
JOINED_WORDS = 500
#: A full stop or comma between an ASCII letter and white space is an id run of its own.
_CLOSING = re.compile(rb"(?<=[a-z])([.,])(?=[\x20\x09-\x0D]|\Z)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Numbers(dict):
    """Numbers words in the order they are first asked for, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordTokens:
    """Ids of texts, encoding each distinct word once.

    The vocabulary's normaliser and splitter treat white space as a separator, so the ids of a text
    are those of its words one after another.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [(t.content, k) for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark, self.mark_id = special[0] if special else (None, -1)
        self._clear()

    def _clear(self) -> None:
        self.index = _Numbers()
        self.pool = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word. Many words go into one call, with a special token between them."""
        texts = [w.decode("utf-8", "replace") for w in words]
        if self.mark is None:
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(e.ids, np.uint32) for e in found]
        marked = [k for k, t in enumerate(texts) if self.mark in t]
        alone = {k: self.tokenizer.encode(texts[k], add_special_tokens=False).ids for k in marked}
        for k in marked:
            texts[k] = ""
        mark = f" {self.mark} "
        joined = [mark.join(texts[k : k + JOINED_WORDS]) + mark for k in range(0, len(texts), JOINED_WORDS)]
        found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        cuts = np.flatnonzero(flat == self.mark_id)
        parts = [flat[a + 1 : b] for a, b in zip([-1, *cuts[:-1].tolist()], cuts.tolist())]
        for k, ids in alone.items():
            parts[k] = np.array(ids, np.uint32)
        return parts

    def _learn(self, words: list[bytes]) -> None:
        parts = self._encode_words(words)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.concatenate(parts)
        n = len(words)
        first = len(self.index) - n
        while first + n > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.start[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + n] = lengths
        self.used += len(flat)

    @staticmethod
    def _plain(text: bytes) -> bytes:
        """The text in a form with the same ids and fewer distinct words.

        The vocabulary lower-cases, so ASCII letters can be lower-cased first, unless a combining
        mark (lead bytes CC and CD) could join them before.
        """
        if b"\xcc" not in text and b"\xcd" not in text:
            text = text.lower()
        return _CLOSING.sub(rb" \1", text)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        if len(self.index) > CACHED_WORDS:
            self._clear()
        texts = [self._plain(t) for t in texts]
        words: list[bytes] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            own = text.split()  # on the six ASCII white-space bytes
            counts[k] = len(own)
            words += own
        if not words:
            return np.zeros(0, np.uint32), counts
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            self._learn(self.index.new)
            self.index.new = []
        length = self.length[at]
        ends = np.cumsum(length)
        source = np.repeat(self.start[at] - (ends - length), length) + np.arange(ends[-1])
        edges = np.concatenate([[0], np.cumsum(counts)])
        upto = np.concatenate([[0], ends])[edges]
        return self.pool[source], np.diff(upto)


_LOADED: dict[str, WordTokens] = {}


def _tokens(path: str) -> WordTokens:
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def token_pieces(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): documents longer than ``capacity`` are cut.

    Null texts count as empty; every document, empty ones too, ends with ``END_ID``.
    """
    path = tokenizer or default_tokenizer()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batch):
        tokens = _tokens(path)
        for rows, texts in text_slices(batch):
            data, offsets = text_bytes(texts)
            raw = data.tobytes()
            ids, counts = tokens.encode([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])])
            sizes = counts + 1
            ends = np.cumsum(sizes)
            full = np.full(int(ends[-1]), END_ID, "<u4")
            kept = np.ones(len(full), bool)
            kept[ends - 1] = False
            full[kept] = ids
            pieces = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(sizes[owner] - start, capacity)
            begin = (ends - sizes)[owner] + start
            view = memoryview(full).cast("B")
            crc = [zlib.crc32(view[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist())]
            out = {
                "doc_id": rows.column("doc_id").take(pa.array(owner)),
                "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc,
            }
            if with_ids:
                cuts = pa.array(np.concatenate([begin, [len(full)]]).astype(np.int32))
                out["ids"] = pa.ListArray.from_arrays(cuts, pa.array(full.astype(np.int32)))
            yield out

    return map_batches(docs.select("doc_id", "text"), run, schema + ", ids array<int>" * with_ids)


class RoomTree:
    """Segment tree over rooms 0..capacity: which rooms have open bins, smallest one at or above."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.width)

    def set(self, room: int, present: bool) -> None:
        k = self.width + room
        self.any[k] = present
        while k > 1:
            k >>= 1
            self.any[k] = self.any[2 * k] | self.any[2 * k + 1]

    def tightest(self, size: int) -> int | None:
        k = self.width + size
        if self.any[k]:
            return size
        while k > 1:
            if not k & 1 and self.any[k + 1]:
                k += 1
                while k < self.width:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.width
            k >>= 1
        return None


def best_fit_decreasing(counts: Mapping[int, int], capacity: int) -> np.ndarray:
    """Moves (length, first rank, pieces, first bin, pieces per bin, offset in the bin), in order.

    Piece ``first rank + j`` of a length goes to bin ``first bin + j // per`` at
    ``offset + (j % per) * length``.
    """
    tree = RoomTree(capacity)
    rooms: dict[int, list[tuple[int, int]]] = {}
    moves, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            rooms.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:  # new bins, as many as the rest needs
                per = min(capacity // size, left)
                first, n = bins, left // per
                bins += n
                room = capacity
            else:
                first, n = rooms[room].pop()
                per = min(room // size, left)
                used = min(n, left // per)
                if used < n:
                    rooms[room].append((first + used, n - used))
                if not rooms[room]:
                    tree.set(room, False)
                n = used
            moves.append((size, rank, n * per, first, per, capacity - room))
            put(room - per * size, first, n)
            rank += n * per
            left -= n * per
    return np.array(moves, np.int64).reshape(-1, 6)


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Every piece with its sequence and its place there; see the module docstring.

    Repeated rows are packed as often as they come; rows without doc_id are packed too, with a
    null id. No rows give no rows. Columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer, capacity, with_ids))
    counts = {int(r.length): r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    moves = spark.sparkContext.broadcast(best_fit_decreasing(counts, capacity))
    buckets = shuffle_partitions(spark)
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = (
        bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n"))
        .select("length", "bucket", "before")
    )
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        bucketed.withColumn("own", F.row_number().over(own) - 1)
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("own") + F.col("before"))
        .drop("own", "before", "bucket")
    )
    names = pieces.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)

    def place(batch):
        m = moves.value
        # Moves are in falling order of length and rising rank: one sorted key for both.
        key = ((capacity - m[:, 0]) << 44) + m[:, 1]
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy()
        hit = np.searchsorted(key, ((capacity - length) << 44) + rank, side="right") - 1
        j = rank - m[hit, 1]
        yield {n: batch.column(n) for n in names} | {
            "sequence_id": m[hit, 3] + j // m[hit, 4],
            "offset": m[hit, 5] + (j % m[hit, 4]) * length,
        }

    return map_batches(ranked.select(*names, "rank"), place, f"{kinds}, sequence_id long, offset long")


def op7_pack(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
