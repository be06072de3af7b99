"""Readers. Each one is a thin, schema-first use of a Spark source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark import schemas as S
from tallymark.functions import fixed as K
from tallymark.functions.predicates import strip


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file with its whole text, name, size and time."""
    return (
        spark.read.format("text")
        .option("wholetext", True)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .option("ignoreMissingFiles", True)
        .load(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_name").alias("file_id"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_modification_time").alias("modified"),
            F.col("value").alias("text"),
        )
    )


def read_analysis(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Document-model results, one JSON document per file (or per line)."""
    return spark.read.schema(S.ANALYSIS).option("multiLine", multi_line).json(path)


def analysis_to_statement(raw: DataFrame, method: str = "bankStatement.us_sdk") -> DataFrame:
    """Fields of the first document that hold something, four of them as columns, text as lines."""
    fields = F.map_filter(
        F.coalesce(
            F.try_element_at("documents", F.lit(1))["fields"],
            F.create_map().cast("map<string,struct<content:string,confidence:double>>"),
        ),
        lambda k, v: F.coalesce(v["content"], F.lit("")) != "",
    )
    staged = raw.withColumn("raw_fields", fields)

    def promoted(name):
        return F.try_element_at("raw_fields", F.lit(name))["content"]

    return staged.select(
        "source",
        F.lit(method).alias("extraction_method"),
        "raw_fields",
        F.when(F.coalesce("content", F.lit("")) != "", F.split("content", "\n"))
        .otherwise(F.array().cast("array<string>"))
        .alias("ocr_text_lines"),
        promoted("AccountNumber").alias("account_number"),
        promoted("BankName").alias("bank_name"),
        promoted("StatementStartDate").alias("statement_start_date"),
        promoted("StatementEndDate").alias("statement_end_date"),
    )


def layout_rows(raw: DataFrame) -> DataFrame:
    """Table rows of layout results: cell contents in column order.

    A table sits inside one input row, so its rows are put together there and nothing is shuffled.
    """
    tables = raw.select("source", F.posexplode("tables").alias("table_no", "t"))
    rows = tables.select(
        "source", "table_no", "t", F.explode(F.array_sort(F.array_distinct(F.col("t.cells.row_index")))).alias("row_index")
    )
    cells = F.array_sort(
        F.transform(
            F.filter(F.col("t.cells"), lambda c: c["row_index"] == F.col("row_index")),
            lambda c: F.struct(c["column_index"].alias("i"), c["content"].alias("c")),
        )
    )
    return rows.select("source", "table_no", "row_index", F.transform(cells, lambda c: c["c"]).alias("cells"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` of a file scan with ``path`` and ``block`` (where its split begins), and the number of each row
    within its split. A task reads its splits one after the other, so counting needs no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            lines = []
            for place in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist()):
                if place != last:
                    last, n = place, 0
                lines.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, pa.int64())], names=[*batch.schema.names, "line"])

    return rows.mapInArrow(work, rows.select("*", F.lit(0).cast("long").alias("line")).schema)


def _placed(rows: DataFrame) -> DataFrame:
    return rows.select(
        "*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    )


def with_position(rows: DataFrame, name: str = "ordinal", start: int = 1) -> DataFrame:
    """:func:`numbered` rows with their position in the whole list: files by path, splits by where they begin,
    rows by line, whatever the size of the splits. What is broadcast is one row a split, which the driver
    holds anyway to plan the scan."""
    counts = rows.groupBy("path", "block").agg((F.max("line") + 1).alias("n"))
    before = F.sum("n").over(Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("path", "block", F.coalesce(before, F.lit(0)).alias("_before"))
    return (
        rows.join(F.broadcast(starts), ["path", "block"])
        .withColumn(name, F.col("_before") + F.col("line") + start)
        .drop("_before", "path", "block", "line")
    )


def read_registry(spark: SparkSession, path: str, ordinal: str | None = None) -> DataFrame:
    """Registry from CSV: all text, trimmed, a spreadsheet's `.0` removed, zeros kept.

    ``ordinal`` names a column with the list order. Without one, it is the position in the files.
    """
    schema = S.REGISTRY_CSV
    if ordinal:
        schema = S.T.StructType([S.T.StructField(ordinal, S.T.LongType()), *schema.fields])
    raw = spark.read.option("header", True).schema(schema).csv(path)
    if not ordinal:
        ordinal = "_position"
        raw = with_position(numbered(_placed(raw)), ordinal)
    number = lambda c: F.regexp_replace(F.trim(F.col(f"`{c}`")), r"\.0$", "")
    return raw.select(
        F.col(ordinal).alias("ordinal"),
        F.trim("`Bank Name`").alias("bank_name"),
        F.trim("Address").alias("address"),
        number("Account Number").alias("account_number"),
        number("Routing Number").alias("routing_number"),
    )


def refresh_registry(registry: DataFrame, path: str) -> None:
    """Write the registry as JSON records; empty and `nan` cells become null, zeros stay."""
    clean = registry.select(
        *[
            F.when(~F.lower(F.trim(F.col(f"`{c}`"))).isin("", "nan"), F.trim(F.col(f"`{c}`"))).alias(c)
            if t == "string"
            else F.col(f"`{c}`")
            for c, t in registry.dtypes
        ]
    )
    clean.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_bank_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(S.BANK_LIST).csv(path)


# --- delimiters ---------------------------------------------------------------------------


#: Characters of a file that its delimiter is judged by.
HEAD = K.SNIFF_BYTES


def delimiter(text, head: int | None = HEAD) -> Column:
    """Delimiter of a text file by its mean number per line in the first ``head`` characters (None: in all)."""
    t = F.col(text) if isinstance(text, str) else text
    start = t if head is None else F.substring(t, 1, head)
    return _delimiter(lambda ch: F.length(start) - F.length(F.replace(start, F.lit(ch), F.lit(""))))


def _delimiter(n: Callable[[str], Column]) -> Column:
    """The rule, given how often a sign occurs."""
    lines = n("\n")
    return (
        F.when((lines > 0) & (n(",") > lines), ",")
        .when((lines > 0) & (n(";") > lines), ";")
        .when((lines > 0) & (n("\t") > lines), "\t")
        .when(n(",") > 0, ",")
        .when(n(";") > 0, ";")
        .when(n("\t") > 0, "\t")
        .when(n("|") > 0, "|")
        .otherwise(",")
    )


def sniff_rows(files: DataFrame, text_col: str = "text", path_col: str = "path") -> DataFrame:
    """Rows of delimited files of mixed delimiters, one row per data line as a map by header.

    Each file is cut by its own delimiter in one pass; the files need no listing on the driver.
    """
    staged = files.withColumn("_d", delimiter(text_col)).withColumn(
        "_lines", F.filter(F.split(F.regexp_replace(text_col, "\r\n?", "\n"), "\n"), lambda x: F.trim(x) != "")
    )
    header = F.transform(_cells(F.col("_lines")[0], F.col("_d")), lambda c: F.trim(c))
    return (
        staged.where(F.size("_lines") > 0)
        .withColumn("_h", header)
        .select(path_col, F.col("_d").alias("delimiter"), "_h", F.posexplode("_lines").alias("row_no", "_l"))
        .where(F.col("row_no") > 0)
        .select(path_col, "delimiter", "row_no", "_h", _cells(F.col("_l"), F.col("delimiter")).alias("_c"))
        .select(
            path_col,
            "delimiter",
            "row_no",
            F.map_from_arrays(
                "_h", F.transform("_h", lambda h, i: F.try_element_at(F.col("_c"), i + F.lit(1)))
            ).alias("cells"),
        )
    )


def positioned_lines(spark: SparkSession, path: str, glob: str = "*", encoding: str = "UTF-8") -> DataFrame:
    """Lines of text files (value, path, block, line). Large files are read by several tasks."""
    raw = (
        spark.read.format("text")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .option("ignoreMissingFiles", True)
        .option("encoding", encoding)
        .load(path)
    )
    return numbered(_placed(raw))


def read_sniffed(spark: SparkSession, path: str, glob: str = "*", head: int = HEAD) -> DataFrame:
    """Rows of delimited files of mixed delimiters, as :func:`sniff_rows`, from files of any size.

    One pass over the first splits finds each file's header line and how often each sign occurs in its first
    ``head`` characters; that is one row a file, no more than the listing that the driver holds, and is
    broadcast to a second pass, which cuts every line where it is read. No file is a row and no line
    is shuffled. ``block`` and ``line`` place a row in its file.
    """
    lines = positioned_lines(spark, path, glob)
    first = lines.where((F.col("block") == 0) & (F.col("line") < head)).withColumn("value", F.rtrim("value", F.lit("\r")))
    signs = (",", ";", "\t", "|")
    # Lines are at least one character long with their end, so the head has at most ``head`` of them.
    order = F.array_sort(F.collect_list(F.struct("line", F.substring("value", 1, head).alias("value"))))
    heads = first.groupBy("path").agg(
        F.substring(F.array_join(F.transform(order, lambda x: x["value"]), "\n"), 1, head).alias("start"),
        F.min_by("value", F.when(F.trim("value") != "", F.col("line"))).alias("header"),
        F.min(F.when(F.trim("value") != "", F.col("line"))).alias("header_line"),
    )
    count = lambda ch: F.length("start") - F.length(F.replace("start", F.lit(ch), F.lit("")))
    counts = heads.select("path", "header", "header_line", *(count(ch).alias(f"n{i}") for i, ch in enumerate(("\n", *signs))))
    n_of = {ch: F.col(f"n{i}") for i, ch in enumerate(("\n", *signs))}
    files = counts.select("path", "header", "header_line", _delimiter(n_of.__getitem__).alias("delimiter"))
    files = files.withColumn("_h", F.transform(_cells(F.col("header"), F.col("delimiter")), lambda c: F.trim(c)))
    rows = lines.where(F.trim("value") != "").withColumn("value", F.rtrim("value", F.lit("\r")))
    data = rows.join(F.broadcast(files), "path").where((F.col("block") > 0) | (F.col("line") > F.col("header_line")))
    cut = data.withColumn("_c", _cells(F.col("value"), F.col("delimiter")))
    cells = F.map_from_arrays("_h", F.transform("_h", lambda h, i: F.try_element_at(F.col("_c"), i + F.lit(1))))
    return cut.select("path", "delimiter", "block", "line", cells.alias("cells"))


def _cells(line: Column, sep: Column) -> Column:
    """Cells of one line; a quoted cell may hold the delimiter."""
    quoted = F.regexp_extract_all(
        F.concat(sep, line), F.concat(F.lit("\\Q"), sep, F.lit('\\E("(?:[^"]|"")*"|[^'), F.concat(F.lit("\\Q"), sep, F.lit("\\E]*)"))), F.lit(1)
    )
    return F.transform(
        quoted,
        lambda c: F.when(
            c.rlike('^".*"$'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
        ).otherwise(c),
    )


def read_delimited(spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8", glob: str = "*") -> DataFrame:
    return (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("pathGlobFilter", glob)
        .csv(path)
    )


# --- JSON of any shape ----------------------------------------------------------------------


def json_rows(files: DataFrame, text_col: str = "text", keys=("path",)) -> DataFrame:
    """Records of JSON files: a list gives its items, an object itself, a scalar one `data` row."""
    t = strip(text_col)
    items = F.from_json(t, "array<string>")
    record = (
        F.when(F.startswith(t, F.lit("[")), items)
        .when(F.startswith(t, F.lit("{")), F.array(t))
        .otherwise(F.array(F.concat(F.lit('{"data":'), t, F.lit("}"))))
    )
    return files.select(*keys, F.posexplode(record).alias("row_no", "record"))


# --- folders -----------------------------------------------------------------------------------


def catalog(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a folder with size and time; contents are never read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
        .select(
            F.col("path"),
            F.element_at(F.split("path", "/"), -1).alias("file_name"),
            F.element_at(F.split("path", "/"), -2).alias("folder"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("modified"),
        )
    )


def recent_files(files: DataFrame, k: int) -> DataFrame:
    return files.orderBy(F.desc("modified"), "path").limit(k)


FORMAT_BY_EXTENSION = {
    "csv": "csv", "txt": "text", "json": "json", "xml": "text", "bai": "bai2", "bai2": "bai2",
    "xlsx": "excel", "xls": "excel", "xlsm": "excel", "pdf": "document",
}


def reader_kind(name) -> Column:
    """Reader of a file by its extension."""
    ext = F.lower(F.regexp_extract(F.col(name) if isinstance(name, str) else name, r"\.([^./]+)$", 1))
    out = F
    for e, kind in FORMAT_BY_EXTENSION.items():
        out = out.when(ext == e, kind)
    return out.otherwise("unknown")


def dispatch(spark: SparkSession, path: str, fields: dict[str, str] | None = None) -> DataFrame:
    """CSV and JSON-lines files of one folder as one frame, each read by its own reader.

    Records come as one VARIANT column, so no file is read beforehand to find a schema; ``fields`` (name to
    type) are taken out of it as columns, null where a record lacks them or has another type.
    """
    read = lambda glob: spark.read.option("pathGlobFilter", glob).option("singleVariantColumn", "record")
    tag = lambda df, kind: df.select(F.lit(kind).alias("source_kind"), "record")
    both = tag(read("*.csv").option("header", True).csv(path), "csv").union(tag(read("*.json").json(path), "json"))
    if fields is None:
        return both
    quoted = lambda c: "$['" + c.replace("'", "\\'") + "']"
    return both.select("source_kind", *(F.try_variant_get("record", quoted(c), t).alias(c) for c, t in fields.items()))


def retention(files: DataFrame, folders, keep: str) -> DataFrame:
    """How many files of each folder a clean-up would remove. A preview: nothing is deleted."""
    is_keep = F.col("file_name") == keep
    return (
        files.where(F.col("folder").isin(list(folders)))
        .groupBy("folder")
        .agg(
            F.count("*").alias("total_files"),
            F.count_if(~is_keep).alias("files_to_delete"),
            F.count_if(is_keep).alias("kept_files"),
        )
    )
