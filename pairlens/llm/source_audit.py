"""How far the sources of a language differ in their terms, by count-level bitmaps.

Terms of a language's documents that at least three of them hold are kept. A group (language and
source) stores for every count the set of terms that occur so often in it, as a bitmap of term
numbers. The AND of two groups' bitmaps and its popcount give how many terms stand at each joint cell
(count here, count there), whatever the vocabulary; a divergence is a sum over cells of popcount
times f. Cells in which a count is zero are not stored: they follow from the sizes of the bitmaps and
the number of terms by complement.

Term numbers are dense within blocks. A block is a hash range of a language's terms that holds about
``BLOCK_CELLS`` (group, term) counts, so one task never gets a language, a hot source or a frequent
term whole; its terms are numbered from the most to the least frequent one, so equal counts stand
side by side and bitmaps are runs of full words. Blocks give partial sums for each pair of sources,
which are added up.

Shares are p = 1 + floor(10^9 (count + 1) / (N + V)), f(p, q) = floor((p - q)^2 / q), all in whole
numbers. A pair's sum is at most about (10^9 + V)^2, which fits a long.

Defined results: null text, language and source count as ''. A document is a row, so repeated ids
and rows count again. Empty texts hold no terms but their group occurs. Very long texts count whole.
Ties are ranked by the item's UTF-8 bytes. Sources of a language without kept terms differ by 0. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.llm.common import stored, table, text_slices

#: What a term is; the operator folds bytes instead, which gives the same runs.
TERM_PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCUMENTS, SHARES, TERM_RANKS = 3, 10**9, 200
#: (group, term) counts of a block, on average; and joint cells worked out at once.
BLOCK_CELLS, JOINT_CELLS = 1 << 14, 1 << 18
#: Terms that a task counts before it hands them on, and rows it hands on at once.
HELD_TERMS, FLUSHED_ROWS = 400_000, 10_000


#: Every byte as it stands in terms: capital ASCII letters small, other ASCII but letters a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)
)


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of every term of a group.

    Tasks count in tables of at most about ``HELD_TERMS`` terms, so a hot group reaches the shuffle as
    a few rows per task and term.
    """

    def run(batches):
        names = ("lang", "source", "term", "n", "docs")
        occurrences: dict[tuple, Counter] = {}
        documents: dict[tuple, Counter] = {}

        def flushed():
            for group, counts in occurrences.items():
                own = documents[group]
                terms = list(counts)
                for lo in range(0, len(terms), FLUSHED_ROWS):
                    part = terms[lo : lo + FLUSHED_ROWS]
                    columns = [
                        pa.array([group[0]] * len(part), pa.string()), pa.array([group[1]] * len(part), pa.string()),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([counts[t] for t in part], pa.int64()), pa.array([own[t] for t in part], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
            occurrences.clear()
            documents.clear()

        for batch in batches:
            for rows, texts in text_slices(batch):
                groups = zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist())
                for group, text in zip(groups, texts.cast(pa.binary()).to_pylist()):
                    terms = text.translate(_FOLD).split()
                    if terms:
                        occurrences.setdefault(group, Counter()).update(terms)
                        documents.setdefault(group, Counter()).update(set(terms))
                if sum(map(len, occurrences.values())) > HELD_TERMS:
                    yield from flushed()
        yield from flushed()

    counted = docs.select("text", *_group()).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _group() -> list[Column]:
    return [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count among ``total`` occurrences of ``terms`` kept terms, exactly; without terms it is not used."""
    wide = F.lit(SHARES).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide, F.greatest(total + terms, F.lit(1)).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """Kept terms, and the totals of every group and language; all stored."""

    def __init__(self, docs: DataFrame):
        of_term = Window.partitionBy("lang", "term")
        counted = term_counts(docs).withColumn("term_docs", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term))
        self.cells = stored(counted.where(F.col("term_docs") >= LEAST_DOCUMENTS).select("lang", "source", "term", "n", "lang_n"))
        groups = docs.select(*_group()).distinct()
        totals = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("cells"))
        terms = self.cells.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
        zero = lambda *names: [F.coalesce(c, F.lit(0)).alias(c) for c in names]
        self.groups = stored(
            groups.join(totals, ["lang", "source"], "left")
            .join(terms, "lang", "left")
            .select("lang", "source", *zero("total", "cells", "terms", "lang_total"))
        )

    def blocks(self) -> DataFrame:
        """``(lang, blocks)``: into how many hash ranges the terms of each language are cut."""
        cells = self.groups.groupBy("lang").agg(F.sum("cells").alias("cells"))
        return cells.select("lang", F.greatest(F.lit(1), F.ceil(F.col("cells") / BLOCK_CELLS)).cast("int").alias("blocks"))

    def bitmaps(self) -> DataFrame:
        """``(lang, block, source, count, word, bits)``: the words of every bitmap that are not zero.

        A row without a word is a group's sign in a block: its total and the block's number of terms.
        """
        block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
        numbered = self.cells.join(self.blocks(), "lang").select("lang", "source", "term", "n", "lang_n", block)
        place = F.dense_rank().over(Window.partitionBy("lang", "block").orderBy(F.desc("lang_n"), "term")) - 1
        words = (
            numbered.withColumn("place", place)
            .groupBy("lang", "block", "source", F.col("n").alias("count"), F.shiftright("place", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, place & 63)")).alias("bits"))
        )
        signs = self.groups.join(self.blocks(), "lang").select(
            "lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source"
        )
        nothing = [F.lit(None).cast(t).alias(c) for t, c in (("long", "count"), ("int", "word"), ("long", "bits"))]
        totals = self.groups.select("lang", "source", "total", "terms")
        return words.union(signs.select("lang", "block", "source", *nothing)).join(totals, ["lang", "source"]).withColumn(
            "p", share(F.coalesce("count", F.lit(0)), F.col("total"), F.col("terms"))
        )

    def pairs(self) -> DataFrame:
        """``(lang, source, item, value)``: divergence of every source from every other of its language."""
        schema = "lang string, source string, item string, value long"
        parts = self.bitmaps().select("lang", "block", "source", "p", "word", "bits").groupBy("lang", "block").applyInArrow(_joint, schema)
        return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def terms(self) -> DataFrame:
        """``(lang, source, item, value)``: terms that a source holds above its language's share."""
        p = share(F.col("n"), F.col("total"), F.col("terms")).alias("p")
        q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")
        shares = self.cells.join(self.groups.drop("cells"), ["lang", "source"]).select("lang", "source", "term", p, q)
        return shares.where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _joint(block: pa.Table) -> pa.Table:
    """The divergence of every ordered pair of sources over the terms of one block.

    With s(a, b) = f(a, b) - f(a, 0) - f(0, b) + f(0, 0), where 0 stands for the share of a count of
    zero, the sum over all terms is the sum of popcount times s over joint cells of stored bitmaps,
    plus bitmap sizes times f(a, 0) - f(0, 0) and f(0, b) - f(0, 0), plus terms times f(0, 0).
    """
    names, group = np.unique(np.array(block["source"].to_pylist(), object), return_inverse=True)
    p = block["p"].to_numpy().astype(np.int64)
    sign = np.asarray(block["word"].is_null())
    zero = np.zeros(len(names), np.int64)
    zero[group[sign]] = p[sign]
    held = ~sign
    group, p = group[held], p[held]
    word = block["word"].filter(pa.array(held)).to_numpy().astype(np.int64)
    bits = block["bits"].filter(pa.array(held)).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(word, kind="stable")
    group, p, word, bits = group[order], p[order], word[order], bits[order]
    ones = np.bitwise_count(bits).astype(np.int64)
    n = len(names)
    value = np.zeros((n, n), np.int64)
    if len(word):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(word)]]))
        terms = int(np.bitwise_count(np.bitwise_or.reduceat(bits, first)).sum())
        # What each bitmap word adds against groups in which its terms have a count of zero.
        for k in range(n):
            own = group == k
            mine, here = p[own], ones[own]
            value[k] += ((_f(mine[:, None], zero) - _f(zero[k], zero)) * here[:, None]).sum(0)
            value[:, k] += ((_f(zero[:, None], mine) - _f(zero, zero[k])[:, None]) * here).sum(1)
        value += terms * _f(zero[:, None], zero)
        low, width = np.repeat(first, sizes), np.repeat(sizes, sizes)
        cuts = np.searchsorted(np.cumsum(width), np.arange(0, int(width.sum()) + JOINT_CELLS, JOINT_CELLS), "right")
        for lo, hi in zip(cuts, cuts[1:]):
            a = np.repeat(np.arange(lo, hi), width[lo:hi])
            ends = np.cumsum(width[lo:hi])
            b = np.arange(len(a)) - np.repeat(ends - width[lo:hi], width[lo:hi]) + low[a]
            both = np.bitwise_count(bits[a] & bits[b]).astype(np.int64)
            met = (both > 0) & (group[a] != group[b])
            a, b, both = a[met], b[met], both[met]
            here, there = zero[group[a]], zero[group[b]]
            s = _f(p[a], p[b]) - _f(p[a], there) - _f(here, p[b]) + _f(here, there)
            np.add.at(value, (group[a], group[b]), both * s)
    a, b = np.nonzero(~np.eye(n, dtype=bool))
    lang = block["lang"][0].as_py()
    return pa.table(
        {
            "lang": pa.array([lang] * len(a), pa.string()),
            "source": pa.array(names[a], pa.string()),
            "item": pa.array(names[b], pa.string()),
            "value": pa.array(value[a, b], pa.int64()),
        }
    )


def audit(docs: DataFrame, ranks: int = TERM_RANKS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: all pairs of sources, and each source's first terms."""
    found = Audit(docs)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    shown = lambda rows, part: rows.withColumn("rank", place).select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", "rank"
    )
    return shown(found.pairs(), "pair").union(shown(found.terms(), "term").where(F.col("rank") <= ranks))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (
    SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM_PATTERN}') AS terms
    FROM documents
), o AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT k) >= {LEAST_DOCUMENTS}),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (
    SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
           1 + {SHARES}::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(t.total, 0) + l.v) AS p,
           1 + {SHARES}::HUGEINT * (kept.n + 1) // (l.total + l.v) AS q
    FROM g JOIN kept USING (lang) JOIN l USING (lang)
    LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), s AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
), k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM k WHERE part = 'pair' OR rank <= {TERM_RANKS}
"""
