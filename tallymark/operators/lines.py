"""The lines of a corpus and what one line carries to the next.

All lines of a document come from one row, so everything is worked out in that row, over arrays of
the same length as its lines, and exploded at the end: no exchange, no sort, linear in the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions import fixed as K
from tallymark.functions.predicates import any_contains, let
from tallymark.operators.transactions import clean_lines


def line_arrays(docs: DataFrame, text_col: str = "text", key_cols=("doc_id",), clean: bool = False) -> DataFrame:
    """Keys and the array ``line`` of each document."""
    text = clean_lines(text_col) if clean else F.col(text_col)
    return docs.select(*key_cols, F.split(text, "\n").alias("line"))


def explode_lines(arrays: DataFrame, key_cols=("doc_id",)) -> DataFrame:
    """One row per line: keys, ``pos`` and the elements of all other (equally long) arrays."""
    rest = [c for c in arrays.columns if c not in key_cols]
    return arrays.select(*key_cols, F.posexplode(F.arrays_zip(*rest)).alias("pos", "_x")).select(
        *key_cols, "pos", *[F.col("_x")[c].alias(c) for c in rest]
    )


def lines_table(docs: DataFrame, text_col: str = "text", key_cols=("doc_id",), clean: bool = False) -> DataFrame:
    return explode_lines(line_arrays(docs, text_col, key_cols, clean), key_cols)


def carried(values: Column, event, value, start: Column) -> Column:
    """Array as long as ``values``: from each element that is an event on ``value(element, number)``,
    ``start`` before the first one. Runs are repeated between the places of events."""
    marked = F.transform(values, lambda x, i: F.struct(i.alias("i"), x.alias("x")))

    def runs(found):
        before = F.array_repeat(start, F.coalesce(F.get(found, F.lit(0))["i"], F.size(values)))
        each = F.transform(
            found,
            lambda e, j: F.array_repeat(value(e["x"], j), F.coalesce(F.get(found, j + 1)["i"], F.size(values)) - e["i"]),
        )
        return F.concat(before, F.flatten(each))

    return let(F.filter(marked, lambda e: event(e["x"])), runs)


def shifted(values: Column) -> Column:
    """Each element's predecessor, null for the first."""
    return F.transform(values, lambda x, i: F.get(values, i - 1))


def with_section(arrays: DataFrame) -> DataFrame:
    """Carry the last DEBITS / CREDITS heading forward."""
    is_head = lambda x: F.upper(x).isin(K.SECTION_NAMES)
    none = F.lit(None).cast("string")
    return arrays.withColumn("section", carried(F.col("line"), is_head, lambda x, j: F.lower(x), none))


def with_segment(arrays: DataFrame) -> DataFrame:
    """Number the segments a date line or a terminator opens."""
    opens = lambda x: x.rlike(f"^{K.TXN_DATE_LINE}$") | F.upper(x).isin(K.SECTION_TERMINATORS)
    number = lambda x, j: (j + 1).cast("bigint")
    return arrays.withColumn("segment", carried(F.col("line"), opens, number, F.lit(0).cast("bigint")))


def with_next_lines(arrays: DataFrame, k: int = 3) -> DataFrame:
    line = F.col("line")
    ahead = lambda n: F.transform(line, lambda x, i: F.get(line, i + n))
    return arrays.withColumns({f"next_{n}": ahead(n) for n in range(1, k + 1)})


def head_lines(lines: DataFrame, k: int) -> DataFrame:
    """First k lines of each document: a filter on ``pos``, no window needed."""
    return lines.where(F.col("pos") < k)


def edge_balance_lines(arrays: DataFrame, k: int = K.DENSE_EDGE_LINES, key_cols=("doc_id",)) -> DataFrame:
    """First and last k lines that speak of a balance or total, with their places from both ends."""
    marked = F.transform("line", lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    hits = F.filter(marked, lambda e: any_contains(F.lower(e["line"]), K.DENSE_BALANCE_WORDS))
    placed = let(
        hits,
        lambda h: F.transform(
            h,
            lambda e, j: F.struct(
                e["pos"].alias("pos"),
                e["line"].alias("line"),
                (j + 1).alias("from_top"),
                (F.size(h) - j).alias("from_end"),
            ),
        ),
    )
    return arrays.select(*key_cols, F.inline(F.filter(placed, lambda e: (e["from_top"] <= k) | (e["from_end"] <= k))))


def counted(values: Column, name: str) -> Column:
    """Array of (name, n): how often each different value occurs in an array. Sorts within the row."""

    def of_sorted(s):
        marked = F.transform(s, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        first = F.filter(marked, lambda e: (e["i"] == 0) | ~F.get(s, e["i"] - 1).eqNullSafe(e["x"]))
        return let(
            first,
            lambda f: F.transform(
                f,
                lambda e, j: F.struct(
                    e["x"].alias(name),
                    (F.coalesce(F.get(f, j + 1)["i"], F.size(s)) - e["i"]).cast("bigint").alias("n"),
                ),
            ),
        )

    return let(F.array_sort(values), of_sorted)


def first_by_priority(hits: DataFrame, value: str, priority: list, key_cols=("doc_id",)) -> DataFrame:
    """Value of the smallest priority per key: an aggregate with map-side combine, not a sort."""
    return hits.groupBy(*key_cols).agg(F.min_by(value, F.struct(*priority)).alias(value))


def with_hierarchy(arrays: DataFrame, key_cols=("file_id",)) -> DataFrame:
    """Open group and account of every BAI2 record, from its type codes in the array ``rec``.

    98 closes a group but leaves its account open; 49 and 02 close an account; a 03 outside a
    group opens nothing.
    """
    rec = F.col("rec")
    off, zero = F.lit(False), F.lit(0).cast("bigint")
    number = lambda x, j: (j + 1).cast("bigint")
    group = carried(rec, lambda x: x.isin("02", "98"), lambda x, j: x == "02", off)
    staged = arrays.withColumns(
        {"_g": let(group, shifted), "_n02": carried(rec, lambda x: x == "02", number, zero)}
    )
    opens = F.zip_with("rec", "_g", lambda r, g: (r == "03") & F.coalesce(g, off))
    staged = staged.withColumn("_opens", opens)
    both = F.zip_with("rec", "_opens", lambda r, o: F.struct(r.alias("r"), o.alias("o")))
    account = carried(both, lambda x: x["o"] | x["r"].isin("02", "49"), lambda x, j: x["o"], off)
    staged = staged.withColumns(
        {"_a": let(account, shifted), "_n03": carried(F.col("_opens"), lambda x: x, number, zero)}
    )
    rows = staged.select(
        *key_cols, F.posexplode(F.arrays_zip("pos", "rec", "_g", "_n02", "_opens", "_a", "_n03")).alias("_i", "_x")
    ).select(*key_cols, "_x.*")
    in_group, in_account = F.coalesce("_g", off), F.coalesce("_a", off)
    return rows.select(
        *key_cols,
        "pos",
        "rec",
        F.when((F.col("rec") == "02") | in_group, F.col("_n02")).alias("group_no"),
        F.when(F.col("_opens") | (in_account & F.col("rec").isin("16", "49")), F.col("_n03")).alias("account_no"),
    )


def record_arrays(files: DataFrame, text_col: str = "text", key_cols=("file_id",)) -> DataFrame:
    """Keys and the arrays ``pos`` and ``rec`` of the lines of each file that aren't blank."""
    marked = F.transform(F.split(text_col, "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    full = F.filter(marked, lambda e: F.trim(e["line"]) != "")
    return files.select(*key_cols, full.alias("_l")).select(
        *key_cols,
        F.col("_l.pos").alias("pos"),
        F.transform("_l", lambda e: F.substring_index(e["line"], ",", 1)).alias("rec"),
    )


def numbered(rows: DataFrame, key_cols, order_cols, out: str = "ref_num") -> DataFrame:
    """Five-digit running number per key."""
    w = Window.partitionBy(*key_cols).orderBy(*order_cols)
    return rows.withColumn(out, F.lpad(F.row_number().over(w).cast("string"), 5, "0"))


def record_fields(line: Column) -> Column:
    """Fields of one record, a line without its line break; the closing slash is not part of the last one."""
    closed = F.endswith(line, F.lit("/"))
    return F.split(F.when(closed, F.left(line, F.length(line) - 1)).otherwise(line), ",", -1)
