"""Fuzzy line deduplication by MinHash over character shingles.

1. Lines (split at line feeds, trimmed, A-Z lower-cased; blank ones stay out) are counted exactly first.
   A line that occurs in a third of all documents is one row from here on; its number is that of
   its first occurrence in reading order.
2. The shingles of ``K`` bytes at every position (of plain ASCII these are the shingles that step 4 compares) are
   hashed, each into one of 32 bins. The smallest hashes of the bins are a line's signature; repeats change nothing,
   and an empty bin is a value too. A line of more than ``KEPT`` shingles has about ``KEPT`` hashes looked at, the
   smallest of all, so its bins' minima are those of all shingles; where most of these turn out to be repeats of a
   few (fewer than ``FEW`` bins filled), the line is done again with all hashes.
3. Bands of ``ROWS`` bins: with 8 bands of 4, a pair of similarity 0.85 shares a band with chance
   0.997 (0.985 at 0.8). The two lines of a band that no other shares are a pair; of more lines each is paired with
   the first.
4. Pairs whose bit maps of shingles show that they can't be similar enough are left out, which is exact. For each other
   pair the Jaccard similarity is computed exactly on the full sets of shingles of ``K`` characters (every
   position); pairs of at least ``least`` are links, and links become components by distributed union-find. Bands
   of three lines and more that are still in different components then compare their pairs across components in the
   same way. Where these would be more than ``MOST`` a line, only those pairs are formed that share one of their
   rarest shingles, which loses none of the similarity asked for.
5. In each component the first occurrence stays; all others are removed.

All steps are DataFrame expressions; nothing but numbers per round reaches the driver. Shingles are hashed by one
expression per position of a piece of ``PIECE`` bytes, which Spark compiles; a higher-order function over all positions
is interpreted once per shingle and took ten times the CPU.

A task holds the pieces of one line and, at a comparison, the shingles of two.

Defined results: null and empty texts have one blank line, which stays; blank lines always stay; rows
that repeat an identifier are documents of their own; null identifiers are kept; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.graph import components
from tallymark.llm.shared import free_name, lower_ascii, stored

K, BINS, BANDS, ROWS = 12, 32, 8, 4
KEPT, FEW = 64, 16
#: Parts in which components that share bands are compared, one after the other: bounds the shuffle files on disk at once.
PARTS = 6
#: Bytes of a piece whose shingles are hashed by one row; the largest hash that is looked at.
PIECE = 32
#: Words of 64 bits in which a line's shingles are marked; pairs a line of a key that are formed without a look at shingles.
WORDS, MOST = 32, 64
TOP, MARK = 2**31 - 1, -1


def lines_of(docs: DataFrame) -> DataFrame:
    """(row, doc_id, pos, occurrence, line): every line; ``line`` normalised, ``occurrence`` in reading order."""
    own = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.split(F.coalesce("text", F.lit("")), "\n").alias("raws"),
    )
    return own.select("row", "doc_id", F.posexplode("raws").alias("pos", "raw")).select(
        "row",
        "doc_id",
        "pos",
        F.monotonically_increasing_id().alias("occurrence"),
        lower_ascii(F.trim("raw")).alias("line"),
    )


def _marks(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("mark"), F.xxhash64(F.lit(1), line).alias("mark2")]


def cut(data: Column, size: int, unit: int = 1) -> Column:
    """Array of pieces of ``size`` characters of ``unit`` bytes that overlap by K - 1, so that each shingle lies in one.
    The outer function holds the bytes once: read from the row, they would be copied for each piece."""

    def pieces(held: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.octet_length(held) - unit * (K - 1)) / F.lit(unit * size)).cast("int") - 1)
        return F.transform(
            F.sequence(F.lit(0), last), lambda c: F.substring(held, c * (unit * size) + 1, F.lit(unit * (size + K - 1)))
        )

    return F.flatten(F.transform(F.array(data), pieces))


def signatures(lines: DataFrame, kept: int | None = KEPT) -> DataFrame:
    """(occurrence, bands, poor) of each line: the keys of the bands that have a value, made of the smallest hash of
    each of their bins; ``kept`` bounds how many hashes of a line are expected to be looked at; ``poor``: these were
    too few. A mark in no band keeps the lines none of whose hashes are small enough. Lines are dealt by number
    first, so both groupings stay where they are; a group holds one band, as each further bin costs every hash."""
    size = F.octet_length("line") - (K - 1)
    limit = F.lit(TOP)
    if kept is not None:
        limit = F.when(size > kept, (F.lit(float(TOP)) * kept / size).cast("int")).otherwise(limit)
    dealt = lines.select("occurrence", "line").repartition("occurrence")
    rows = dealt.select("occurrence", limit.alias("limit"), F.posexplode(cut(F.col("line").cast("binary"), PIECE)).alias("no", "piece"))
    rows = rows.withColumn("last", F.greatest(F.lit(1), F.octet_length("piece") - (K - 1)))
    at = [F.least(F.lit(i), F.col("last")) for i in range(1, PIECE + 1)]
    each = [F.xxhash64(F.substring(F.col("piece"), i, F.lit(K))) for i in at]
    mark = F.when(F.col("no") == 0, F.lit(MARK).cast("long")).otherwise(each[0])
    rows = rows.select("occurrence", "limit", F.explode(F.array(*each, mark)).alias("h"))
    value, bin_ = F.shiftrightunsigned("h", 33), F.col("h").bitwiseAND(BINS - 1).cast("int")
    rows = rows.where((value <= F.col("limit")) | (F.col("h") == MARK)).select(
        "occurrence",
        "limit",
        F.when(F.col("h") != MARK, F.floor(bin_ / ROWS).cast("int")).alias("band"),
        (bin_ % ROWS).alias("bin"),
        value.cast("int").alias("value"),
    )
    least = [F.min(F.when(F.col("bin") == r, F.col("value"))).alias(f"m{r}") for r in range(ROWS)]
    rows = rows.groupBy("occurrence", "limit", "band").agg(*least)
    bins = [F.col(f"m{r}") for r in range(ROWS)]
    key = F.xxhash64("band", *[F.coalesce(m, F.lit(-1)) for m in bins])
    filled = sum((m.isNotNull().cast("int") for m in bins), F.lit(0))
    rows = rows.select("occurrence", "limit", "band", key.alias("key"), F.when(F.col("band").isNotNull(), filled).alias("filled"))
    keys = [F.max(F.when(F.col("band") == k, F.col("key"))) for k in range(BANDS)]
    poor = (F.col("limit") != TOP) & (F.coalesce(F.sum("filled"), F.lit(0)) < FEW)
    return rows.groupBy("occurrence", "limit").agg(F.array_compact(F.array(*keys)).alias("bands"), poor.alias("poor")).drop("limit")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(line, occurrence, n, mark, mark2) of each different line that isn't blank, written once."""
    out = lines.where("line != ''").groupBy("line").agg(F.min("occurrence").alias("occurrence"), F.count("*").alias("n"))
    return stored(out.select("line", "occurrence", "n", *_marks(F.col("line"))), "line-texts", "zstd")


def candidates(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys that two lines share and no other, as pairs (a, b), and the lines of the keys that more share, as
    (key, occurrence, first); ``first`` is the first line of the key. Keys are counted and not sorted, and only the
    lines of those with three or more are looked up."""
    signed = stored(signatures(known), "line-signatures")
    keys = signed.where("not poor").select(F.explode("bands").alias("key"), "occurrence")
    poor = stored(signed.where("poor").select("occurrence"), "line-poor")
    if not poor.isEmpty():
        again = signatures(known.join(poor.hint("shuffle_hash"), "occurrence", "left_semi"), None)
        keys = keys.union(stored(again.select(F.explode("bands").alias("key"), "occurrence"), "line-again"))
    held = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("occurrence").alias("first"), F.max("occurrence").alias("last"))
    held = stored(held.where("n > 1"), "line-keys")
    many = held.where("n > 2").select("key", "first")
    return held.where("n = 2").selectExpr("first a", "last b"), stored(keys.join(many.hint("shuffle_hash"), "key"), "line-candidates")


def shingles(line: Column) -> Column:
    """The hash of each shingle of a line, in order; a shorter line is one shingle. The outer function holds the
    characters, four bytes each, once."""

    def of(held: Column) -> Column:
        last = F.greatest(F.lit(0), (F.octet_length(held) / 4).cast("int") - K)
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.substring(held, i * 4 + 1, F.lit(4 * K))))

    return F.flatten(F.transform(F.array(F.encode(line, "utf-32")), of))


def verified(pairs: DataFrame, lines: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the similarity ``least``, shingle by shingle (by 64-bit hashes)."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("occurrence")).distinct()
    texts = lines.join(needed, "occurrence").select("occurrence", "line")
    both = pairs.join(texts.toDF("a", "line_a"), "a").join(texts.toDF("b", "line_b"), "b")
    sets = F.struct(shingles(F.col("line_a")).alias("x"), shingles(F.col("line_b")).alias("y"))
    both = both.select("a", "b", F.explode(F.array(sets)).alias("sets"))  # a row each, so they are computed once
    shared, all_ = F.size(F.array_intersect("sets.x", "sets.y")), F.size(F.array_union("sets.x", "sets.y"))
    return both.where(shared >= all_ * least).select("a", "b")


def bitmaps(lines: DataFrame) -> DataFrame:
    """(occurrence, unit, size, ones, bits): one of ``WORDS`` x 64 bits is set for each shingle of a line; ``size`` is
    the number of its shingles, repeats counted, ``ones`` that of its bits. Lines of ``unit`` 1 are plain ASCII, the
    others are cut by characters of four bytes."""
    plain = F.octet_length("line") == F.length("line")
    rows = lines.select("occurrence", "line").repartition("occurrence")
    both = []
    for unit, some, data in ((1, plain, F.col("line").cast("binary")), (4, ~plain, F.encode("line", "utf-32"))):
        part = rows.where(some).select("occurrence", F.explode(cut(data, PIECE, unit)).alias("piece"))
        part = part.withColumn("last", F.greatest(F.lit(0), F.octet_length("piece") - unit * K))
        at = [unit * i for i in range(PIECE)]
        each = [F.when(F.col("last") >= i, F.xxhash64(F.substring(F.col("piece"), i + 1, unit * K))) for i in at]
        hashed = part.select("occurrence", F.explode(F.array(*each)).alias("h")).where("h is not null")
        bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 58) as int))")
        words = hashed.groupBy("occurrence", F.col("h").bitwiseAND(WORDS - 1).alias("word")).agg(
            F.count("*").alias("n"), F.bit_or(bit).alias("bits")
        )
        held = [F.coalesce(F.max(F.when(F.col("word") == w, F.col("bits"))), F.lit(0).cast("long")) for w in range(WORDS)]
        ones = F.sum(F.bit_count("bits")).alias("ones")
        words = words.groupBy("occurrence").agg(F.sum("n").alias("size"), ones, F.array(*held).alias("bits"))
        both.append(words.select("occurrence", F.lit(unit).alias("unit"), "size", "ones", "bits"))
    return both[0].union(both[1])


def sifted(pairs: DataFrame, bits: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that may reach the similarity ``least``, exactly: a bit that only one line has stands for a
    shingle that only it has. If c shingles are shared and u are not, c (1 - least) >= u least; u is at least the
    number of bits that one line has alone, and c at most a line's size less its own such bits. With i bits in common
    both are linear in i."""
    parts = ("unit", "size", "ones", "bits")
    x = bits.select(F.col("occurrence").alias("a"), *[F.col(c).alias(f"{c}_a") for c in parts])
    y = bits.select(F.col("occurrence").alias("b"), *[F.col(c).alias(f"{c}_b") for c in parts])
    both = pairs.join(x, "a").join(y, "b")
    common = F.zip_with("bits_a", "bits_b", lambda v, w: F.bit_count(v.bitwiseAND(w)))
    common = F.aggregate(common, F.lit(0), lambda n, c: n + c)
    spare = F.least(F.col("size_a") - F.col("ones_a"), F.col("size_b") - F.col("ones_b"))
    enough = (F.col("ones_a") + F.col("ones_b")) * least - spare * (1 - least)
    return both.where((F.col("unit_a") != F.col("unit_b")) | (common * (1 + least) + 1e-6 >= enough)).select("a", "b")


def across(still: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of lines in (key, occurrence, root) that lie in different components and may reach ``least``:
    two lines are a pair only if they share one of their rarest shingles. Sets x and y of similarity t share one of
    the first |x| - ceil(t |x|) + 1 shingles of x, and likewise of y, in any order of all shingles: here those that
    only one component has, then the others from the rarest among all lines of ``still`` to the commonest; and no
    more shingles come before the first shared one, in x and y together, than both may have for themselves. So a
    family of lines with one beginning or one passage does not give all its pairs; one of near copies that do not link may."""
    lines = still.select("occurrence", "root").distinct().join(known.select("occurrence", "line"), "occurrence")
    sets = F.transform(
        F.array(F.array_distinct(shingles(F.col("line")))), lambda s: F.struct(F.size(s).alias("size"), s.alias("set"))
    )
    grams = lines.select("occurrence", "root", F.explode(sets).alias("one"))
    grams = grams.select("occurrence", "root", F.col("one.size").alias("size"), F.explode("one.set").alias("shingle"))
    alike, own = Window.partitionBy("shingle"), Window.partitionBy("occurrence")
    grams = grams.select("*", *[f("root").over(alike).alias(n) for f, n in ((F.count, "held"), (F.min, "lo"), (F.max, "hi"))])
    more = grams.where("lo < hi")  # the others of a line come first in its order
    place = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("held", "shingle"))
    first = more.withColumn("at", place.cast("int")).where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1)
    rows = stored(first.select("shingle", "occurrence", "root", "lo", "size", "at"), "line-rarest")
    # most lines of a shingle are likely in the component of its smallest root: these are not paired with each other
    x = rows.where("root > lo").select("shingle", *[F.col(c).alias(f"{c}_x") for c in ("occurrence", "root", "size", "at")])
    y = rows.select("shingle", *[F.col(c).alias(f"{c}_y") for c in ("occurrence", "root", "size", "at")])
    sizes = F.col("size_x") + F.col("size_y")
    alone = sizes - 2 * F.ceil(sizes * (least / (1 + least)) - 1e-9)
    both = x.join(y, "shingle").where("root_x > root_y").where(F.col("at_x") + F.col("at_y") - 2 <= alone)
    both = both.where(F.least("size_x", "size_y") >= F.greatest("size_x", "size_y") * least - 1e-9)
    a, b = F.least("occurrence_x", "occurrence_y"), F.greatest("occurrence_x", "occurrence_y")
    return both.select(a.alias("a"), b.alias("b")).distinct()


def parted(still: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """The pairs of ``across``, part by part. Lines whose components share no key, not even by way of others, have no
    band in common and may be in different parts; ``lo`` is the smallest root of a key."""
    groups = components(still.select("root", "lo"))
    still = stored(rooted(still, groups, "root", "group").select("key", "occurrence", "root", "group"), "line-groups")
    part = F.pmod(F.xxhash64("group"), F.lit(PARTS))
    pairs = [stored(across(still.where(part == i), known, least), "line-pairs") for i in range(PARTS)]
    return reduce(DataFrame.union, pairs)


def rooted(rows: DataFrame, roots: DataFrame, of: str, into: str) -> DataFrame:
    """``rows`` with the root of the line in column ``of``; a line without another one is its own."""
    return rows.join(roots.toDF(of, into), of, "left").withColumn(into, F.coalesce(into, of))


def unlinked(members: DataFrame, roots: DataFrame, near: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of lines of different components that share a key of ``members`` (key, occurrence, first) and were
    not compared with its first line. A key with at most ``MOST`` such pairs a line gives them all; the lines of the
    others, large groups of unlike lines, meet by their rarest shingles."""
    labelled = stored(rooted(members, roots, "occurrence", "root").select("key", "occurrence", "first", "root"), "line-labelled")
    per_root = labelled.groupBy("key", "root").agg(F.count("*").alias("n"))
    n, square = F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n"))
    keys = per_root.groupBy("key").agg(
        F.min("root").alias("lo"), ((n.cast("double") * n - square) / 2 > n * MOST).alias("large"), F.count("*").alias("roots")
    )
    keys = stored(keys.where("roots > 1").select("key", "lo", "large"), "line-open-keys")
    still = stored(labelled.join(keys.hint("shuffle_hash"), "key"), "line-open")
    few = still.where("not large and occurrence > first").select("key", "occurrence", "root")
    x, y = few.toDF("key", "a", "root_a"), few.toDF("key", "b", "root_b")
    pairs = x.join(y, "key").where("a < b and root_a != root_b").select("a", "b").distinct()
    large = still.where("large").select("key", "occurrence", "root", "lo")
    return pairs if large.isEmpty() else pairs.union(parted(large, near, least)).distinct()


def line_components(lines: DataFrame, least: float = 0.8) -> DataFrame:
    """(mark, mark2, root) of each different line that occurs more than once or isn't its component's
    first; ``root`` is the occurrence that stays."""
    known = distinct_lines(lines)
    two, members = candidates(known)
    pairs = two.union(members.where("occurrence > first").select("first", "occurrence")).distinct()
    # all further steps look up these lines only, so the texts of all lines are shuffled by occurrence a single time
    some = pairs.select(F.explode(F.array("a", "b")).alias("occurrence")).distinct()
    near = known.select("occurrence", "line").join(some.hint("shuffle_hash"), "occurrence", "left_semi")
    near = stored(near, "line-banded", "zstd")
    bits = stored(bitmaps(near), "line-bits")

    def links(found: DataFrame) -> DataFrame:
        return stored(verified(stored(sifted(found, bits, least), "line-sifted"), near, least), "line-links")

    roots = components(links(pairs))
    more = links(unlinked(members, roots, near, least))
    if not more.isEmpty():
        joined = components(rooted(rooted(more, roots, "a", "root_a"), roots, "b", "root_b").select("root_a", "root_b"))
        roots = rooted(roots.toDF("node", "old"), joined, "old", "root").select("node", "root").union(joined)
    out = rooted(known.select("occurrence", "n", "mark", "mark2"), roots.hint("shuffle_hash"), "occurrence", "root")
    return out.where("n > 1 or root != occurrence").select("mark", "mark2", "root")


def deduplicate_lines(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Each row of ``docs``: row, doc_id, n_lines, n_kept, removed (positions of the lines that go)."""
    lines = lines_of(docs)
    groups = line_components(lines, least)
    marked = lines.where("line != ''").select("row", "pos", "occurrence", *_marks(F.col("line")))
    gone = marked.join(groups.hint("shuffle_hash"), ["mark", "mark2"]).where("occurrence != root")
    removed = gone.groupBy("row").agg(F.array_sort(F.collect_list("pos")).alias("removed"))
    own = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(1)).cast("long").alias("n_lines"),
    )
    empty = F.array().cast("array<int>")
    both = own.join(removed, "row", "left").withColumn("removed", F.coalesce("removed", empty))
    return both.select("row", "doc_id", "n_lines", (F.col("n_lines") - F.size("removed")).alias("n_kept"), "removed")


def cleaned(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``; all columns and rows stay."""
    row, gone = free_name(docs, "row"), free_name(docs, "removed")
    removed = deduplicate_lines(docs, least).where(F.size("removed") > 0)
    removed = removed.select(F.col("row").alias(row), F.col("removed").alias(gone))
    both = docs.withColumn(row, F.monotonically_increasing_id()).join(removed, row, "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return both.withColumn("text", text).select(docs.columns)
