"""Alignment of two tokenizers' ids over a corpus, by inverted bitmaps of id pairs.

A text with a space in front is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B).
Where tokens of both end at the same byte the text is cut into groups, and the two tokens that end
there are linked. Both vocabularies start a token at every space that follows a character which is
not white space, so a text is worked out as a sequence of such chunks and each distinct chunk is
encoded and aligned once per worker.

Documents are numbered inside blocks. For every linked id pair a block has bitmaps of its documents,
compressed to the 64-bit words that are not zero, one bitmap for each binary digit of the number of
links (multiplicity planes). Bitmaps of slices of a block are merged by OR. The popcount of the OR of
all planes is the pair's documents, popcounts weighted by the planes' digits are its links. Sums over
blocks give the corpus-wide counts. One of two linked tokens ends with the bytes of the other, so the
vocabularies alone bound the number of pairs, and the table of scores may be broadcast. The postings
then carry each pair's score back to the documents.

Defined results: null and empty texts, and texts whose joined A or B bytes are not the space and the
text, have no tokens, zeros and an empty digest. Very long texts are worked out whole, chunk by chunk.
Rows are told apart by their place and not by ``doc_id``: null and repeated ids give one result row
each. Ties for the highest count of a B id all count as best. An empty table gives no rows. Other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import list_array, map_batches, stored, table, text_slices

#: A block ends at so many documents (16 bits, in 1024 words of 64) or bitmap words.
BLOCK_DOCS, BLOCK_WORDS = 1 << 16, 1 << 20
#: Chunks that a worker remembers, and their bytes; past either it starts anew.
CACHED_CHUNKS, CACHED_BYTES = 500_000, 64 << 20
#: Rows of one arrow batch of bitmaps, and bitmap words decoded at once.
BATCH_ROWS, DECODED_WORDS = 8192, 1 << 15
#: Splitting rule of byte-level vocabularies (fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What pieces write for a space (fixed value of the format).
MARK = "▁"

_WIDE_GAP = re.compile(r"\s ")
_CHUNK_EDGE = re.compile(r"(?<=\S)(?= )")

SCHEMA = (
    "block long, ord int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, "
    "a int, b int, n_docs long, n_links long, places array<int>, bits array<long>"
)


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in set(shown)]
    return {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}


class ByteVocabulary:
    """Encodes with a byte-level vocabulary file; strings of special tokens are plain text.

    Where every merge makes the next id, ids are ranks, and a rank encoder gives the same ids faster.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = _bytes_of_letters()
        special = {t["content"] for t in model["added_tokens"]}
        vocabulary = model["model"]["vocab"]
        entries = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items() if t not in special}
        size = max(vocabulary.values()) + 1
        self.bytes = [entries.get(i, b"") for i in range(size)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        splitter = model["pre_tokenizer"]
        ranked = (
            model["normalizer"] is None
            and splitter["type"] == "ByteLevel"
            and splitter["use_regex"]
            and not splitter["add_prefix_space"]
            and all(vocabulary.get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
            and len(entries) == 256 + len(merges)
        )
        if ranked:
            import tiktoken

            ranks = {b: i for i, b in entries.items()}
            encoding = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [encoding.encode_ordinary(t) for t in texts]
        else:
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.encode = lambda texts: [
                e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ]
        self.cuts_at_spaces = ranked


class PieceVocabulary:
    """Encodes with a piece model, which puts a space in front of every text itself."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self._model, self._mark = model, [model.piece_to_id(MARK)]
        self.cuts_at_spaces = all(MARK not in p.lstrip(MARK) for p in pieces) and model.encode("a b") == [
            *model.encode("a"),
            *model.encode("b"),
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text after a space; of the space alone for an empty one."""
        found = self._model.encode(texts, num_threads=1)
        return [ids if t else self._mark for t, ids in zip(texts, found)]


class _Numbers(dict):
    """Numbers chunks in the order they are first asked for, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number


class _Pool:
    """A numpy array that grows by appending."""

    def __init__(self, kind):
        self.values, self.used = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        while self.used + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[self.used : self.used + len(values)] = values
        self.used += len(values)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for ids in lists for i in ids), np.int64, int(sizes.sum())), sizes


class Aligner:
    """Aligns texts chunk by chunk and remembers the chunks."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteVocabulary(path_a), PieceVocabulary(path_b)
        self.whole = not (self.a.cuts_at_spaces and self.b.cuts_at_spaces)
        self.n_b = len(self.b.bytes)
        self._size_a, self._size_b = (np.array([len(x) for x in v.bytes], np.int64) for v in (self.a, self.b))
        ids = max(len(self.a.bytes), self.n_b)
        self._signs = [b"%d%s" % (i, end) for end in (b",", b"|", b";") for i in range(ids)]
        self._ids = ids
        self.clear()

    def clear(self) -> None:
        self.index = _Numbers()
        self.groups: list[bytes] = []
        self.fits, self.counts_a, self.counts_b = _Pool(bool), _Pool(np.int64), _Pool(np.int64)
        self.links, self.first, self.counts = _Pool(np.int64), _Pool(np.int64), _Pool(np.int64)
        self._bytes = 0

    def trim(self) -> None:
        if len(self.index) > CACHED_CHUNKS or self._bytes > CACHED_BYTES:
            self.clear()

    def chunks(self, text: str) -> list[str]:
        """The text's chunks without their first space; a space before the text is implied."""
        if self.whole:
            return [text]
        if _WIDE_GAP.search(text) is None and not text.startswith(" "):
            return text.split(" ")
        return [c[1:] for c in _CHUNK_EDGE.split(" " + text)]

    def number(self, text: str) -> list[int]:
        """Numbers of the text's chunks, none for an empty text; ``learn`` must follow."""
        return list(map(self.index.__getitem__, self.chunks(text))) if text else []

    def learn(self) -> None:
        """Aligns the chunks that were numbered since the last call."""
        chunks, self.index.new = self.index.new, []
        if not chunks:
            return
        ids_a, ids_b = self.a.encode([" " + c for c in chunks]), self.b.encode(chunks)
        raw = [b" " + c.encode() for c in chunks]
        bytes_a, bytes_b = self.a.bytes, self.b.bytes
        fits = np.fromiter(
            (
                b"".join([bytes_a[i] for i in x]) == r and b"".join([bytes_b[i] for i in y]) == r
                for x, y, r in zip(ids_a, ids_b, raw)
            ),
            bool,
            len(chunks),
        )
        if not fits.all():
            ids_a = [x if ok else [] for x, ok in zip(ids_a, fits)]
            ids_b = [y if ok else [] for y, ok in zip(ids_b, fits)]
        a, n_a = _flat(ids_a)
        b, n_b = _flat(ids_b)
        ends_a, ends_b = np.cumsum(self._size_a[a]), np.cumsum(self._size_b[b])
        last_a = np.flatnonzero(np.isin(ends_a, ends_b, assume_unique=True))
        last_b = np.searchsorted(ends_b, ends_a[last_a])
        # A group's A ids come first, then its B ids: each side moves on by what the other has before it.
        place_a = np.arange(len(a)) + np.concatenate([[0], last_b + 1])[np.searchsorted(last_a, np.arange(len(a)))]
        place_b = np.arange(len(b)) + (last_a + 1)[np.searchsorted(last_b, np.arange(len(b)))]
        sign = np.empty(len(a) + len(b), np.int64)
        sign[place_a], sign[place_b] = a, b
        sign[place_a[last_a]] += self._ids
        sign[place_b[last_b]] += 2 * self._ids
        signs = list(map(self._signs.__getitem__, sign.tolist()))
        edges = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        self.groups += [b"".join(signs[lo:hi])[:-1] for lo, hi in zip(edges, edges[1:])]
        self._bytes += sum(map(len, self.groups[-len(chunks) :])) + sum(map(len, raw))
        found = np.searchsorted(last_a, np.concatenate([[0], np.cumsum(n_a)]))
        self.first.add(self.links.used + found[:-1])
        self.counts.add(np.diff(found))
        self.links.add(a[last_a] * self.n_b + b[last_b])
        self.fits.add(fits)
        self.counts_a.add(n_a)
        self.counts_b.add(n_b)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


class Block:
    """Bitmaps of one block of documents: (pair, plane, word) and 64 documents' bits."""

    def __init__(self, number: int):
        self.number, self.docs, self.words = number, 0, 0
        self._parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, pairs: np.ndarray, docs: np.ndarray) -> None:
        """Adds a slice's links: the pair and the number of the document of each."""
        if not len(pairs):
            return
        links, times = np.unique(pairs << 16 | docs, return_counts=True)
        keys, bits = [], []
        for plane in range(int(times.max()).bit_length()):
            at = links[times >> plane & 1 == 1]
            keys.append(at >> 16 << 16 | plane << 10 | (at & 0xFFFF) >> 6)
            bits.append(np.uint64(1) << (at & 63).astype(np.uint64))
        self._parts.append(_merged(np.concatenate(keys), np.concatenate(bits)))
        self.words += len(self._parts[-1][0])

    def rows(self) -> Iterator[dict]:
        """The merged bitmaps of every pair, with their documents and links."""
        if not self._parts:
            return
        keys, bits = _merged(*map(np.concatenate, zip(*self._parts)))
        ones = np.bitwise_count(bits).astype(np.int64)
        pairs = keys >> 16
        first = _starts(pairs)
        links = np.add.reduceat(ones << (keys >> 10 & 63), first)
        any_keys, any_bits = _merged(pairs << 10 | keys & 1023, bits)
        docs = np.add.reduceat(np.bitwise_count(any_bits).astype(np.int64), _starts(any_keys >> 10))
        sizes = np.diff(np.concatenate([first, [len(keys)]]))
        for lo in range(0, len(first), BATCH_ROWS):
            hi = min(lo + BATCH_ROWS, len(first))
            cut = slice(first[lo], first[hi - 1] + sizes[hi - 1])
            yield {
                "block": np.full(hi - lo, self.number),
                "pair": pairs[first[lo:hi]],
                "n_docs": docs[lo:hi],
                "n_links": links[lo:hi],
                "places": list_array((keys[cut] & 0xFFFF).astype(np.int32), sizes[lo:hi]),
                "bits": list_array(bits[cut].view(np.int64), sizes[lo:hi]),
            }


def _merged(keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the OR of their bits."""
    order = np.argsort(keys, kind="stable")
    keys, bits = keys[order], bits[order]
    first = _starts(keys)
    return keys[first], np.bitwise_or.reduceat(bits, first)


def _aligned_slice(aligner: Aligner, texts: pa.Array, block: Block) -> dict:
    """Counts and digests of a slice's documents; their links go into the block."""
    numbers = [aligner.number(t) for t in texts.to_pylist()]
    aligner.learn()
    chunk, sizes = _flat(numbers)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    misfits = np.bincount(doc[~aligner.fits.values[chunk]], minlength=len(sizes))
    valid = (misfits == 0) & (sizes > 0)
    kept = valid[doc]
    chunk, doc = chunk[kept], doc[kept]
    of = lambda pool: np.bincount(doc, pool.values[chunk], len(sizes)).astype(np.int64)  # noqa: E731  exact below 2**53
    counts = aligner.counts.values[chunk]
    ends = np.cumsum(counts)
    links = aligner.links.values[np.repeat(aligner.first.values[chunk] - ends + counts, counts) + np.arange(counts.sum())]
    block.add(links, np.repeat(doc, counts) + block.docs)
    groups = aligner.groups
    digests = [
        hashlib.sha256(b";".join([groups[k] for k in numbers[d]])).hexdigest() if valid[d] else ""
        for d in range(len(sizes))
    ]
    return {
        "ord": np.arange(len(sizes)) + block.docs,
        "n_a": of(aligner.counts_a),
        "n_b": of(aligner.counts_b),
        "n_groups": of(aligner.counts),
        "groups_sha256": digests,
    }


def index_pairs(docs: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """Stored rows of two kinds: documents (``a`` null) and bitmaps of id pairs (``ord`` null)."""
    path_a, path_b = tokenizers or default_tokenizers()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def batch(columns: dict) -> pa.RecordBatch:
        n = len(columns["block"])
        arrays = []
        for field in schema:
            values = columns.get(field.name)
            if values is None:
                arrays.append(pa.nulls(n, field.type))
            elif isinstance(values, pa.Array):
                arrays.append(values.cast(field.type))
            else:
                arrays.append(pa.array(values, field.type))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def bitmaps(block: Block, n_b: int) -> Iterator[pa.RecordBatch]:
        for rows in block.rows():
            pair = rows.pop("pair")
            yield batch(rows | {"a": pair // n_b, "b": pair % n_b})

    def run(batches):
        aligner = _aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        block = Block(number)
        for rows in batches:
            for cut, texts in text_slices(rows):
                if block.docs + len(texts) > BLOCK_DOCS or block.words > BLOCK_WORDS:
                    yield from bitmaps(block, aligner.n_b)
                    number += 1
                    block = Block(number)
                found = _aligned_slice(aligner, texts, block)
                yield batch(found | {"block": np.full(len(texts), number), "doc_id": cut.column("doc_id")})
                block.docs += len(texts)
                aligner.trim()
        yield from bitmaps(block, aligner.n_b)

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA))


def pair_scores(index: DataFrame) -> DataFrame:
    """``(a, b, n_docs, n_links, best)``: counts of every linked id pair over the corpus.

    ``best`` tells whether no pair of the same B id has more links.
    """
    pairs = stored(
        index.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    )
    top = pairs.groupBy("b").agg(F.max("n_links").alias("top"))
    return stored(pairs.join(F.broadcast(top), "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("top")).alias("best")))


def _postings(rows: pa.RecordBatch) -> Iterator[dict]:
    """Per document of the batch's bitmaps: links of best pairs and the sum of counts over links."""
    sizes = np.asarray(rows.column("places").value_lengths()).astype(np.int64)
    places = np.asarray(rows.column("places").flatten()).astype(np.int64)
    bits = np.asarray(rows.column("bits").flatten())
    owner = np.repeat(np.arange(rows.num_rows), sizes)
    block, count = (np.asarray(rows.column(c)) for c in ("block", "score"))
    best = np.asarray(rows.column("best").cast(pa.int64()))
    for lo in range(0, len(places), DECODED_WORDS):
        cut = slice(lo, lo + DECODED_WORDS)
        word, bit = np.nonzero(np.unpackbits(bits[cut].astype("<i8").view(np.uint8), bitorder="little").reshape(-1, 64))
        place, row = places[cut][word], owner[cut][word]
        doc = (place & 1023) << 6 | bit
        order = np.lexsort((doc, block[row]))
        doc, row, links = doc[order], row[order], 1 << (place[order] >> 10)
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (block[row[1:]] != block[row[:-1]])]))
        yield {
            "block": block[row[first]],
            "ord": doc[first],
            "n_links": np.add.reduceat(links, first),
            "n_best": np.add.reduceat(links * best[row], first),
            "count_sum": np.add.reduceat(links * count[row], first),
        }


def align_tokens(docs: DataFrame, tokenizers: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, id pairs): counts, digest of groups and scores of each; see the module."""
    index = index_pairs(docs, tokenizers)
    scores = pair_scores(index)
    score = F.broadcast(scores.select("a", "b", F.col("n_links").alias("score"), "best"))  # bounded by the vocabularies
    bitmaps = index.where("a IS NOT NULL").select("a", "b", "block", "places", "bits").join(score, ["a", "b"])
    sums = (
        map_batches(bitmaps.drop("a", "b"), _postings, "block long, ord int, n_links long, n_best long, count_sum long")
        .groupBy("block", "ord")
        .agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
    )
    counts = ["n_links", "n_best", "count_sum"]
    rows = index.where("ord IS NOT NULL").select("block", "ord", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    return rows.join(sums, ["block", "ord"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "groups_sha256"
    ), scores


def op13_token_alignment(spark, sf_dir):
    return align_tokens(table(spark, sf_dir, "documents"))[0]
