"""Sinks: JSON orientations, CSV, BAI2 text and archive copies. All writes are distributed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.streaming.ingest import run_once

ORIENTS = ("records", "values", "index", "split", "table")


def json_column(df: DataFrame, orient: str = "records", ordinal: str | None = None) -> DataFrame:
    """One JSON text per row in the given orientation; values keep their JSON types.

    ``split`` and ``table`` are the rows part; :func:`write_json` writes their header (columns or
    schema) beside them, so no orientation has to pass the whole table through one place. With an
    ``ordinal`` a row of ``split`` also carries its index.
    """
    cols = [c for c in df.columns if c != ordinal]
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    # The JSON of one value is that of a one-field object without its frame {"v": }.
    objects = [F.to_json(F.struct(F.col(f"`{c}`").alias("v")), {"ignoreNullFields": "false"}) for c in cols]
    plain = [F.substring(o, F.lit(6), F.length(o) - 6) for o in objects]
    values = F.concat(F.lit("["), F.concat_ws(",", *plain), F.lit("]"))
    if orient in ("records", "table"):
        text = F.to_json(row, {"ignoreNullFields": "false"})
    elif orient == "split" and ordinal:
        text = F.concat(F.lit('{"index":'), F.col(ordinal).cast("string"), F.lit(',"data":'), values, F.lit("}"))
    elif orient in ("values", "split"):
        text = values
    elif orient == "index":
        text = F.to_json(F.create_map(F.col(ordinal).cast("string"), row), {"ignoreNullFields": "false"})
    else:
        raise ValueError(f"unknown orientation {orient}")
    keep = [F.col(ordinal)] if ordinal else []
    return df.select(*keep, text.alias("value"))


def json_header(df: DataFrame, orient: str = "split", ordinal: str | None = None) -> dict:
    cols = [(c, t) for c, t in df.dtypes if c != ordinal]
    if orient == "split":
        return {"columns": [c for c, _ in cols]}
    return {"schema": {"fields": [{"name": c, "type": t} for c, t in cols]}}


def write_json(df: DataFrame, path: str, orient: str = "records", ordinal: str | None = None) -> None:
    """Rows below ``path``; columns or schema of ``split`` and ``table`` below ``path``-header."""
    out = json_column(df, orient, ordinal).select("value")
    out.write.mode("overwrite").text(path)
    if orient in ("split", "table"):
        header = json.dumps(json_header(df, orient, ordinal))
        df.sparkSession.createDataFrame([(header,)], "value string").write.mode("overwrite").text(f"{path}-header")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def bai2_sink() -> type:
    """Data source ``bai2``: a file per row of (status, output_name, text), in a folder per status.

    A task writes each file under a name of its own and then renames it to the final one, so readers never see
    half a file and a task that runs again, or a replay of the whole job, leaves one copy. The final name is
    the row's, whatever task writes it. A failed job removes what its tasks left unrenamed; a finished one
    leaves a manifest with the number of files by status, and in ``_files`` a list of names from each task, so
    that readers need not have the whole folder listed in one place.
    """
    # Defined here so that it travels to the workers by value.
    import json as js
    import uuid
    from dataclasses import dataclass

    from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

    def place(path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def local(path: str) -> str:
        return "file://" + path.removeprefix("file:") if path.startswith("file:/") and "://" not in path else path

    @dataclass
    class Written(WriterCommitMessage):
        files: dict
        listed: str | None = None

    class Writer(DataSourceWriter):
        def __init__(self, path: str, job: str):
            self.path, self.job = local(path), job

        def write(self, iterator):
            store, base = place(self.path)
            # A folder of the task's own: tasks don't wait for each other to make files.
            staging = f"{base}/_staging-{self.job}/{uuid.uuid4().hex}"
            files: dict = {}
            names: list = []
            for row in iterator:
                status, name, text = row["status"], row["output_name"], row["text"]
                if not name or "/" in name or name.startswith((".", "_")):
                    raise ValueError(f"not a file name: {name!r}")
                if status not in files:
                    files[status] = 0
                    store.create_dir(f"{base}/{status}", recursive=True)
                    store.create_dir(staging, recursive=True)
                own = f"{staging}/{uuid.uuid4().hex}"
                with store.open_output_stream(own) as f:
                    f.write((text or "").encode())
                store.move(own, f"{base}/{status}/{name}")
                files[status] += 1
                names.append(js.dumps({"status": status, "output_name": name}))
            part = f"{self.job}-{uuid.uuid4().hex}.json"
            if names:
                with store.open_output_stream(f"{staging}/{part}") as f:
                    f.write("\n".join(names).encode())
            return Written(files, f"{staging}/{part}" if names else None)

        def _clean(self):
            store, base = place(self.path)
            from pyarrow import fs

            staging = f"{base}/_staging-{self.job}"
            if store.get_file_info(staging).type == fs.FileType.Directory:
                store.delete_dir(staging)
            return store, base

        def commit(self, messages):
            store, base = place(self.path)
            store.create_dir(f"{base}/_files", recursive=True)
            for m in messages:
                if m and m.listed:
                    store.move(m.listed, f"{base}/_files/{m.listed.rsplit('/', 1)[1]}")
            self._clean()
            total: dict = {}
            for m in messages:
                for status, n in (m.files if m else {}).items():
                    total[status] = total.get(status, 0) + n
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/_manifest.json") as f:
                f.write(js.dumps(total, sort_keys=True).encode())

        def abort(self, messages):
            self._clean()

    class Bai2Files(DataSource):
        @classmethod
        def name(cls):
            return "bai2"

        def schema(self):
            return "status string, output_name string, text string"

        def writer(self, schema, overwrite):
            return Writer(self.options["path"], uuid.uuid4().hex)

    return Bai2Files


def write_bai2(files: DataFrame, path: str, audits: DataFrame | None = None) -> None:
    """A ``.bai`` (or ``ERROR_*.bai``) file per row of (status, output_name, text) below ``path``, and the
    audits of the repair as JSON records beside them. Files of the same name are replaced."""
    files.sparkSession.dataSource.register(bai2_sink())
    files.select("status", "output_name", "text").write.format("bai2").option("path", path).mode("append").save()
    if audits is not None:
        audits.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/_audit")


def _texts_of_files(path: str):
    """Worker of :func:`read_bai2`: the texts of the files named in batches of (status, output_name)."""
    # Defined here so that it travels to the workers by value.
    import pyarrow as pa

    def place(path: str):
        from pyarrow import fs

        if path.startswith("file:/") and "://" not in path:
            path = "file://" + path.removeprefix("file:")
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def read(batches):
        store, base = place(path)

        def text(status, name):
            try:
                with store.open_input_stream(f"{base}/{status}/{name}") as f:
                    return f.read().decode("utf-8", "replace")
            except FileNotFoundError:
                return None

        for batch in batches:
            # So many texts are in memory at once.
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                texts = [text(s.as_py(), n.as_py()) or None for s, n in zip(some["status"], some["output_name"])]
                out = pa.table([some["status"], some["output_name"], pa.array(texts, pa.string())], ["status", "output_name", "text"])
                yield from out.filter(out["text"].is_valid()).to_batches()

    return read


def read_bai2(spark: SparkSession, path: str) -> DataFrame:
    """The files of :func:`write_bai2`: status, output_name, text. A file without content gives no row.

    The names come from the lists of the finished jobs, as rows, each name once; tasks read the files. Spark's own
    file source would have the driver list them all and deal out a task for every few dozen."""
    names = spark.read.schema("status string, output_name string").json(f"{path}/_files")
    # A fixed number of parts: by the bytes of the names alone a few tasks would read all files.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = names.repartition(parts, "status", "output_name").dropDuplicates()
    return names.mapInArrow(_texts_of_files(path), "status string, output_name string, text string")


def archive_once(stream: DataFrame, work, out: str, checkpoint: str) -> None:
    """Process a file stream whose source has ``cleanSource`` set to archive, and let every finished file move.

    The source moves the files of a micro-batch when the next one begins, so the stream is run again until
    nothing is new; with the cleaner's own threads off, a move is done when its batch is. A replayed
    batch rewrites its own folder, and a file that was moved is not found again.
    """
    spark = stream.sparkSession
    key = "spark.sql.streaming.fileSource.cleaner.numThreads"
    before = spark.conf.get(key)
    spark.conf.set(key, "0")
    try:
        run_once(stream, work, out, checkpoint)
    finally:
        spark.conf.set(key, before)
