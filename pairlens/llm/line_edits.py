"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines are the parts of a text between line feeds. Equal lines are grouped first. A line of length l
is split into threshold-plus-one even segments; if two lines are within the threshold, some segment
of the shorter one occurs unchanged in the longer one, at a place that the lengths and the number
of the segment bound. Segments are indexed by (l, number, content), and every line probes the
lengths l, l-1, .. l-threshold with the few substrings that can matter.

A segment that many lines share is not expanded into pairs. Its lines are compared with one hub, and
those that still stand in several classes are dealt again by where they leave the hub: the number of
first characters and of last characters that they share with it. If two lines within the threshold
share different numbers of first characters with the hub, they part where the shorter number ends,
and the other line goes on as the hub does. One of the three edits that give that line the hub's next
character there thus brings it nearer to the other; the same holds at the end. So every line is
dealt together with what it becomes by such edits, and two lines within the threshold either become
the same or agree in both numbers before the threshold is used up. Where that still leaves large
buckets, one of their own lines is their next hub. Only members of one bucket are joined, in pairs
of different classes and about equal length.

Candidates are verified by Spark's edit distance over the band of diagonals that the threshold
allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import NO_ID, WORD_PATTERN, class_labels, hub_order, listed, stored, table

THRESHOLD = 2
#: Shorter lines are matched exactly only: with two edits they are often other lines.
LEAST_CHARS = 20
#: Largest product of index and probe lines of a segment that is expanded into pairs.
SMALL_BUCKET = 64
#: So many (ordered) pairs of different classes per matched row are expanded even from large ones.
PAIRS_PER_ROW = 2
#: Rows that one task deals anew.
ROWS_PER_TASK = 5_000
_LINES_PER_DOC = 1 << 31


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def positions(docs: DataFrame) -> DataFrame:
    """(pos, doc_id, text_hash, line_no, line): pos orders lines by (doc_id, line_no), no id last."""
    doc = F.coalesce("doc_id", F.lit(NO_ID)).cast("decimal(38,0)")
    rows = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(split_lines(F.col("text"))).alias("line_no", "line")
    )
    return rows.select(
        (doc * F.lit(_LINES_PER_DOC) + F.col("line_no")).cast("decimal(38,0)").alias("pos"),
        "doc_id", "text_hash", "line_no", "line",
    )


def line_key() -> list[Column]:
    return [F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("h2")]


def probe_places(threshold: int, index_only: bool) -> list[tuple[int, int, int]]:
    """(characters fewer, segment, shift) of every probe; those with no shift and none fewer are
    the index."""
    out = []
    for fewer in range(1 if index_only else threshold + 1):
        for number in range(threshold + 1):
            low = max(-number, fewer - (threshold - number))
            high = min(number, fewer + (threshold - number))
            out += [(fewer, number, shift) for shift in ([0] if index_only else range(low, high + 1))]
    return out


def probes(rows: DataFrame, threshold: int, index_only: bool = False) -> DataFrame:
    """(h, key, own) of every probe of ``rows`` (h, line, n), n the line's characters.

    ``own`` marks the probes that are also the line's index entries. Lines need more characters than
    the threshold.

    The places are exploded first and each row then computes one key: one expression with all keys
    would make a method too long for the JVM to compile.
    """
    parts = threshold + 1
    places = F.array(*[
        F.struct(F.lit(f).alias("fewer"), F.lit(k).alias("number"), F.lit(d).alias("shift"))
        for f, k, d in probe_places(threshold, index_only)
    ])
    n, number = F.col("n"), F.col("number")
    whole = F.floor((n - F.col("fewer")) / parts).cast("int")
    short = parts - (n - F.col("fewer")) % parts  # the segments after these take one more
    placed = rows.select("h", "line", "n", F.inline(places)).select(
        "*",
        (whole * number + F.greatest(number - short, F.lit(0)) + F.col("shift")).cast("int").alias("at"),
        (whole + F.when(number >= short, 1).otherwise(0)).cast("int").alias("size"),
        ((F.col("fewer") == 0) & (F.col("shift") == 0)).alias("own"),
    )
    fits = (n - F.col("fewer") >= parts) & (F.col("at") >= 0) & (F.col("at") + F.col("size") <= n)
    segment = F.col("line").substr(F.col("at") + 1, F.col("size"))
    return placed.where(fits).select("h", F.xxhash64(n - F.col("fewer"), number, segment).alias("key"), "own")


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether two strings are within ``threshold`` edits; only the band that allows is worked out."""
    return F.levenshtein(a, b, threshold) >= 0


def _verified(pairs: DataFrame, lines: DataFrame, threshold: int) -> DataFrame:
    """(a, b, ok) for pairs of line hashes."""
    ok = within(F.col("line_a"), F.col("line_b"), threshold)
    return _with_texts(pairs, lines).select("a", "b", ok.alias("ok"))


def _with_texts(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs of line hashes with ``line_a`` and ``line_b``."""
    ids = stored(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct())
    texts = stored(lines.join(listed(ids), "h", "left_semi").select("h", "line"))
    return pairs.join(texts.toDF("a", "line_a"), "a").join(texts.toDF("b", "line_b"), "b")


def _shared(a: Column, b: Column, last: bool = False) -> Column:
    """Number of first (or last) characters that two strings share.

    Shared bytes are found bit by bit from the top, as places in bytes need no reading of the
    characters before them, and then counted as characters; one cut by the end does not count.
    """
    x, y = a.cast("binary"), b.cast("binary")
    least = F.least(F.octet_length(a), F.octet_length(b))

    def part(text: Column, done: Column, size: Column) -> Column:
        return F.substr(text, F.octet_length(text) - done - size + 1 if last else done + 1, size)

    def step(done: Column, bit: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1), bit)
        return F.when((done + size <= least) & (part(x, done, size) == part(y, done, size)), done + size).otherwise(done)

    top = F.floor(F.log2(F.greatest(least, F.lit(1)))).cast("int")
    done = F.aggregate(F.sequence(top, F.lit(0), F.lit(-1)), F.lit(0), step)
    if last:
        rest = F.substr(x, F.lit(1), F.octet_length(a) - done).cast("string")
        return F.length(a) - F.length(rest)
    after = F.substr(x, done + 1, F.lit(1))
    cut = (after >= F.lit(b"\x80")) & (after < F.lit(b"\xc0"))
    return F.length(F.substr(x, F.lit(1), done).cast("string")) - F.when(cut, 1).otherwise(0)


def _towards(text: Column, hub: Column, first: Column, last: Column) -> Column:
    """The (at most six) strings that one edit makes of ``text`` where it leaves ``hub``."""
    n, m = F.length(text), F.length(hub)

    def edits(head: Column, own: Column, other: Column, tail: Column, put: Column) -> list[Column]:
        """``other`` for ``own``, ``own`` left out, and both as ``put``; null where there is none."""
        swap = F.when((own != "") & (other != ""), F.concat(head, other, tail))
        return [swap, F.when(own != "", F.concat(head, tail)), F.when(other != "", F.concat(head, put, tail))]

    def at(s: Column, i: Column) -> Column:
        return F.when((i >= 1) & (i <= F.length(s)), s.substr(i, F.lit(1))).otherwise("")

    end = n - last
    own, other = at(text, first + 1), at(hub, first + 1)
    left = edits(text.substr(F.lit(1), first), own, other, text.substr(first + 2, n), F.concat(other, own))
    own, other = at(text, end), at(hub, m - last)
    right = edits(text.substr(F.lit(1), end - 1), own, other, text.substr(end + 1, n), F.concat(own, other))
    return F.array_distinct(F.array_compact(F.array(*left, *right)))


def _dealt(rows: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Deals the members (key, hub_text, h, label, text, used) of buckets by where they leave the hub.

    ``text`` is what ``used`` edits made of line h. Returns such members of the new buckets, without
    ``hub_text``, and the pairs (a, b) of lines that became the same.
    """
    columns = ["key", "hub_text", "h", "label", "text", "used"]
    placed, ends, made = [], [], rows.select(*columns)
    for _ in range(threshold):
        made = stored(
            made.where(F.col("used") < threshold)
            .withColumn("first", _shared(F.col("text"), F.col("hub_text")))
            .withColumn("last", _shared(F.col("text"), F.col("hub_text"), last=True))
        )
        placed.append(made)
        nearer = _towards(F.col("text"), F.col("hub_text"), F.col("first"), F.col("last"))
        made = made.select(
            "key", "hub_text", "h", "label", F.explode(nearer).alias("text"), (F.col("used") + 1).alias("used")
        )
        ends.append(made.where(F.col("used") == threshold))
    whole = placed[0]
    for more in placed[1:]:
        whole = whole.unionByName(more)
    # Strings that come of few edits first: all lines that reach one are linked through the nearest.
    reached = whole.select("h", "used", "text")
    for end in ends:
        reached = reached.unionByName(end.select("h", "used", "text"))
    reached = stored(reached.select("h", "used", F.xxhash64("text").alias("w")).distinct())
    nearest = reached.groupBy("w").agg(F.min(F.struct("used", "h")).alias("near"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = reached.join(nearest, "w").where(F.col("used") + F.col("near.used") <= threshold)
    same = same.select(F.col("near.h").alias("a"), F.col("h").alias("b")).where("a <> b")
    return whole.select(F.xxhash64("key", "first", "last").alias("key"), "h", "label", "text", "used"), stored(same)


def _apart_pairs(told: DataFrame, threshold: int) -> DataFrame:
    """(a, b): pairs of different classes that may be within the threshold, of lines (h, label, text)
    with their hub (key, hub_text)."""
    rows, used, pairs, left = told.count(), F.col("used"), None, None
    members = told.withColumn("used", F.lit(0))
    # Few rows, but much work on each: spread over all cores, and further as they grow.
    parts = max(told.sparkSession.sparkContext.defaultParallelism, rows // ROWS_PER_TASK)
    while True:
        dealt, same = _dealt(members.repartition(parts, "h"), threshold)
        pairs = same if pairs is None else pairs.union(same)
        # Rows of which two may still have edits left; buckets without any were settled as the same.
        able = F.when(used * 2 < threshold, hub_order("used", "h"))
        per_class = dealt.groupBy("key", "label").agg(
            F.count(F.lit(1)).cast("double").alias("members"), F.max_by("text", able).alias("hub_text")
        )
        # No pair is within the largest class of a key, so only the others look for partners.
        size = F.struct("members", "label")
        buckets = stored(
            per_class.groupBy("key").agg(
                F.max_by("label", size).alias("most"), F.count(F.lit(1)).alias("classes"),
                ((F.sum("members") - F.max("members")) * F.sum("members")).alias("product"),
                F.max_by("hub_text", F.when(F.col("hub_text").isNotNull(), size)).alias("hub_text"),
            ).where("classes > 1 and hub_text is not null")
        )
        big = F.col("product") > SMALL_BUCKET
        product = buckets.agg(F.coalesce(F.sum(F.when(big, F.col("product"))), F.lit(0))).first()[0]
        # Large buckets are dealt again while that leaves less than half of their pairs.
        last = product <= PAIRS_PER_ROW * rows or left is not None and product > left / 2
        left = product
        done = buckets if last else buckets.where(~big)
        held = dealt.join(done.select("key", "most"), "key").withColumn("n", F.length("text"))
        one = held.where("label <> most").select("key", F.col("h").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("used").alias("ua"))
        two = held.select(F.col("key").alias("key_b"), "most", F.col("h").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("used").alias("ub"))
        met = one.join(two, F.expr(
            f"key = key_b and la <> lb and (lb = most or a < b) and ua + ub < {threshold} and abs(na - nb) <= {threshold} - ua - ub"
        ))
        pairs = stored(pairs.union(met.select("a", "b")))
        if last:
            return pairs
        members = dealt.join(buckets.where(big).select("key", "hub_text"), "key")


def edit_links(lines: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(verified links (a, b), class labels (id, label)) of lines (h, line), all by their hash h."""
    fuzzy = lines.where(F.length("line") >= max(LEAST_CHARS, threshold + 1)).select(
        "h", "line", F.length("line").alias("n")
    )
    index = probes(fuzzy, threshold, index_only=True).groupBy("key").agg(
        F.count(F.lit(1)).alias("indexed"), F.min("h").alias("hub")
    )
    # Every line meets its own index entries; a segment matters if some other line meets it.
    met = stored(
        probes(fuzzy, threshold).join(index, "key").where("indexed > 1 or hub <> h")
        .select("key", "h", "own", "indexed", "hub").distinct()
    )
    sizes = met.where("indexed > 1").groupBy("key", "indexed").agg(F.count(F.lit(1)).alias("probing"))
    sizes = stored(sizes.withColumn("product", F.col("indexed") * F.col("probing")))
    rows = met.count()
    large_keys, small_keys = _split(sizes, rows)
    members = met.where("indexed > 1")
    small = members.join(small_keys, "key", "left_semi")
    pairs = (
        met.where("hub <> h").select(F.col("hub").alias("a"), F.col("h").alias("b"))
        .union(
            small.where("own").select("key", F.col("h").alias("a"))
            .join(small.select("key", F.col("h").alias("b")), "key").select("a", "b")
        )
    )
    tested = stored(_verified(_new_pairs(pairs, None), lines, threshold))
    labels = class_labels(tested.where("ok"))
    if large_keys is None:
        return tested.where("ok").select("a", "b"), labels
    # Members of large segments, by hub; a hub whose lines are all in one class has no pair left.
    hot = stored(members.join(large_keys, "key", "left_semi").where("hub <> h").select("hub", "h").distinct())
    classed = hot.join(labels.withColumnRenamed("id", "h"), "h", "left").withColumn("label", F.coalesce("label", "h"))
    mixed = classed.groupBy("hub").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    classed = stored(classed.join(mixed.select("hub"), "hub", "left_semi"))
    told = _with_texts(classed.select(F.col("hub").alias("a"), F.col("h").alias("b"), "label"), lines)
    told = stored(told.select(
        F.col("a").alias("key"), F.col("line_a").alias("hub_text"), F.col("b").alias("h"), "label", F.col("line_b").alias("text")
    ))
    pairs = _apart_pairs(told, threshold)
    tested = stored(tested.unionByName(_verified(_new_pairs(pairs, tested), lines, threshold)))
    return tested.where("ok").select("a", "b"), class_labels(tested.where("ok"))


def _split(buckets: DataFrame, rows: int) -> tuple[DataFrame | None, DataFrame]:
    """Keys of the buckets to compare with a hub (None if there are none) and of those to expand.

    Where all pairs of the large buckets are no more than ``rows``, those that segments matched, they
    are simply taken.
    """
    big = F.col("product") > SMALL_BUCKET
    pairs = buckets.agg(F.coalesce(F.sum(F.when(big, F.col("product"))), F.lit(0))).first()[0]
    if pairs <= PAIRS_PER_ROW * rows:
        return None, buckets.select("key")
    return buckets.where(big).select("key"), buckets.where(~big).select("key")


def _new_pairs(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    out = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if tested is not None:
        out = out.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    return stored(out)


def line_classes(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(h, h2, first, copies, class_pos, class_h) of every distinct line; positions as in ``positions``.

    A class's first line is the one of smallest position; where rows repeat a position with other
    lines, the one of smaller hash.
    """
    lines = stored(
        positions(docs).groupBy("line").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("copies"))
        .select("pos", "copies", *line_key(), "line")
    )
    _, labels = edit_links(lines, threshold)
    known = lines.select("pos", "copies", "h", "h2").join(labels.withColumnRenamed("id", "h"), "h", "left")
    known = stored(known.withColumn("label", F.coalesce("label", "h")))
    first = known.groupBy("label").agg(F.min(F.struct("pos", "h")).alias("first_line"))
    return known.join(first, "label").select(
        "h", "h2", F.col("pos").alias("first"), "copies",
        F.col("first_line.pos").alias("class_pos"), F.col("first_line.h").alias("class_h"),
    )


def duplicate_lines(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, line_no, class_doc_id, class_line_no, copies, duplicate), one row per line.

    A class is what links of at most ``threshold`` edits connect; its id is its first line by
    (doc_id, line_no). All its other lines are duplicates. Lines shorter than ``LEAST_CHARS`` are
    linked to equal lines only, and lines of white space are never duplicates. Null texts have no
    lines, empty ones one empty line; texts and lines of any length are taken whole. Repeated rows
    repeat their lines with the same position, so a first line stays first in each of them. Rows that
    repeat a doc_id with another text are documents of their own: their lines are told apart by
    content, and of several at the class's first position one is first. Rows without doc_id come
    last and count as one document in that. Ties cannot occur. Other columns are not read.
    """
    return _judged(docs, threshold).drop("text_hash")


def _judged(docs: DataFrame, threshold: int) -> DataFrame:
    known = stored(line_classes(docs, threshold))
    rows = positions(docs).select(
        "pos", "doc_id", "line_no", "text_hash", *line_key(), (~F.col("line").rlike(WORD_PATTERN)).alias("blank")
    )
    class_doc = F.floor(F.col("class_pos") / F.lit(_LINES_PER_DOC).cast("decimal(38,0)")).cast("long")
    first = (F.col("pos") == F.col("class_pos")) & (F.col("h") == F.col("class_h"))
    return rows.join(known, ["h", "h2"]).select(
        "doc_id", "line_no", "text_hash",
        F.when(class_doc < NO_ID, class_doc).alias("class_doc_id"),
        (F.col("class_pos") - class_doc.cast("decimal(38,0)") * F.lit(_LINES_PER_DOC)).cast("int").alias("class_line_no"),
        "copies",
        (~first & ~F.col("blank")).alias("duplicate"),
    )


def drop_duplicate_lines(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with duplicate lines cut out of ``text``; documents left without text go.

    Lines are cut from the rows they stand in: rows are told apart by doc_id and text. Documents
    without duplicate lines keep their exact text, null texts included, and rows without doc_id are
    not cut. ``n_chars``, where there is such a column, is set to the new length of changed texts.
    All columns of ``docs`` stay, whatever their names.
    """
    removed = stored(
        _judged(docs.select("doc_id", "text"), threshold).where("duplicate and doc_id is not null")
        .groupBy(F.col("doc_id").alias("_cut_id"), F.col("text_hash").alias("_cut_text"))
        .agg(F.collect_set("line_no").alias("_removed"))
    )
    numbered = F.transform(split_lines(F.col("text")), lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    kept = F.transform(
        F.filter(numbered, lambda e: ~F.array_contains(F.col("_removed"), e["i"])), lambda e: e["line"]
    )
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    # The lists have no size bound, so they are never broadcast.
    same = (F.col("doc_id") == F.col("_cut_id")) & (F.xxhash64("text") == F.col("_cut_text"))
    out = docs.join(removed.hint("merge"), same, "left").withColumn("_text", text)
    out = out.where(F.col("_removed").isNull() | F.col("_text").rlike(WORD_PATTERN))
    columns = [
        F.col("_text").alias("text") if c == "text"
        else F.when(F.col("_removed").isNull(), F.col(c)).otherwise(F.length("_text")).cast(docs.schema[c].dataType).alias(c)
        if c == "n_chars" else F.col(c)
        for c in docs.columns
    ]
    return out.select(*columns)


def op9_line_edits(spark, sf_dir):
    return duplicate_lines(table(spark, sf_dir, "documents"))
