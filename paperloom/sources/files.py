"""What the bank is written to and read from: CSV export, session documents, slices that are rebuilt."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.checkpoints import cut, new_folder

# Headers of the export.
CSV_HEADERS = {
    "canonical_text": "Question Wording",
    "priority_level": "Priority Level",
    "priority_score": "Priority Score (0-100)",
    "avg_marks": "Average Marks",
    "occurrences": "Occurrence Count",
    "topic": "Topic/Chapter",
    "priority_reason": "Priority Analysis Reason",
}


def files_of(spark: SparkSession, path: str) -> bool:
    """Whether anything has been written there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


#: Files to a folder that tasks write, and to a slice of a folder's own names that a task reads; bytes of a file that are held at a time; rows of a batch.
FOLDER_FILES, CHUNK_BYTES, BATCH_ROWS = 1_000, 1 << 20, 1_000


def _local(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder that Python can open as well; None for one in another store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.makeQualified(where).toUri().getPath() if files.getUri().getScheme() == "file" else None


def write_texts(rows: DataFrame, folder: str) -> None:
    """Each row's text (name, text; neither null) as a file of that name and a line end, somewhere below the folder. Rows of one name are files of their own.

    Where Python can open the folder, a task writes its files aside, `FOLDER_FILES` to a folder, and renames all of them into place when it is done, so an attempt that fails or comes second leaves nothing.
    Hadoop's local files take a folder, a checksum and two processes each. In another store Spark's writer makes a folder of each name.
    """
    root = _local(rows.sparkSession, folder)
    if root is None:
        # tasks put their own files in place; else the driver renames all of them, one after the other
        rows.select("name", "text").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("name").text(folder)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        aside, n, held = f"{root}/_{part}-{uuid.uuid4().hex}", 0, 0
        try:
            for batch in batches:
                for name, text in zip(batch["name"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                    if not n or held == FOLDER_FILES or os.path.exists(f"{aside}/{n}/{name}"):
                        n, held = n + 1, 0
                        os.makedirs(f"{aside}/{n}")
                    with open(f"{aside}/{n}/{name}", "xb") as file:
                        file.write(text + b"\n")
                    held += 1
            if n:
                os.rename(aside, f"{root}/{part}")
        except BaseException as failed:
            shutil.rmtree(aside, ignore_errors=True)
            # an attempt that was first has all of this task's files in place
            if not os.path.isdir(f"{root}/{part}") or not isinstance(failed, OSError):
                raise
        yield from ()

    os.makedirs(root)
    rows.select("name", "text").mapInArrow(write, "done int").write.format("noop").mode("overwrite").save()


def _listed(folder: str) -> tuple[list[str], list[str]]:
    """Names of the files and paths of the folders in a folder, but for those that Spark's sources pass over."""
    names, folders = [], []
    with os.scandir(folder) as found:
        for x in found:
            if (x.name.startswith("_") and "=" not in x.name and not x.name.startswith(("_metadata", "_common_metadata"))) or x.name.startswith(".") or x.name.endswith("._COPYING_"):
                continue
            if x.is_dir():
                folders.append(x.path)
            else:
                names.append(x.name)
    return names, folders


def _units(root: str, least: int) -> list[tuple[str, list[str] | None]]:
    """What tasks list and read: folders whole (None), or some of the names of a folder. Folders are gone through from the top until there are `least`."""
    if os.path.isfile(root):
        return [(os.path.dirname(root), [os.path.basename(root)])]
    units: list[tuple[str, list[str] | None]] = []
    folders = [root]
    while folders and (folders == [root] or len(units) + len(folders) < least):
        below = []
        for folder in folders:
            names, inside = _listed(folder)
            units += [(folder, names[i : i + FOLDER_FILES]) for i in range(0, len(names), FOLDER_FILES)]
            below += inside
        folders = below
    return units + [(folder, None) for folder in folders]


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path and length of the files of units."""

    def below(folder: str, names: list[str] | None) -> Iterator[str]:
        stack = [] if names is not None else [folder]
        yield from (f"{folder}/{name}" for name in names or ())
        while stack:
            at = stack.pop()
            inside, folders = _listed(at)
            stack += folders
            yield from (f"{at}/{name}" for name in inside)

    for batch in batches:
        for unit in batch.to_pylist():
            files = below(unit["folder"], unit["names"])
            while paths := list(islice(files, BATCH_ROWS)):
                yield pa.RecordBatch.from_pydict({"path": [f"file:{x}" for x in paths], "length": pa.array([os.stat(x).st_size for x in paths], pa.int64())})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """content_hash beside the other columns; only files that are accepted are opened."""

    def digest(path: str) -> str:
        whole = hashlib.sha256()
        with open(path, "rb") as file:
            while chunk := file.read(CHUNK_BYTES):
                whole.update(chunk)
        return whole.hexdigest()

    for batch in batches:
        found = [digest(path.removeprefix("file:")) if accepted else None for path, accepted in zip(batch["path"].to_pylist(), batch["accepted"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "content_hash"])


def paper_files(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """A1, A4: path, filename, length, accepted (the name ends in the suffix, in any case) and content_hash (SHA-256 of the bytes; null for rejects) of every file below a folder.

    A file that a writer of Spark's has named goes by its folder's name, and of `name=value` the value counts. Files are listed and opened once; bytes are hashed where they are read, and neither sent nor joined.
    Files without any bytes hold no paper; Spark's source passes over them. Where Python can open the folder, tasks list it: Spark's source has every file's status and place on the driver. Names
    that aren't UTF-8 can't be told apart by a path of characters and are an error.
    """
    value = F.regexp_extract("path", r"/[^/=]*=([^/]*)/part-[^/]*$", 1)
    last = F.regexp_extract(F.regexp_replace("path", r"/part-[^/]*$", ""), r"([^/]*)$", 1)
    # values in names of folders are escaped, other names aren't
    name = F.when(value != "", F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))).otherwise(last)
    named = lambda files: files.withColumn("filename", name).withColumn("accepted", F.lower("filename").endswith(suffix))
    root = _local(spark, folder)
    if root is None:
        found = named(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "content"))
        return found.select("path", "filename", "length", "accepted", F.when(F.col("accepted"), F.sha2("content", 256)).alias("content_hash"))
    units = spark.createDataFrame(_units(root, 4 * spark.sparkContext.defaultParallelism), "folder string, names array<string>")
    found = named(units.mapInArrow(_walked, "path string, length long").filter("length > 0"))
    columns = "path string, filename string, length long, accepted boolean"
    return found.select("path", "filename", "length", "accepted").mapInArrow(_hashed, f"{columns}, content_hash string")


def export_csv(bank: DataFrame, path: str, late: Callable[[DataFrame], DataFrame] = lambda rows: rows, codes: DataFrame | None = None) -> None:
    """The ranked bank under fixed headers, best first; a question without topic is Uncategorized.

    late adds the columns that follow from a row's others; rows are sorted without them. codes: all wordings (text) and their numbers (w) in the order of content_hash, if they are few; rows
    then have numbers in place of wordings and hashes while they are sorted.
    """
    rows = bank.withColumn("topic", F.coalesce("topic", F.lit("Uncategorized")))
    if codes is not None:
        # a sort reads its rows twice, so they are written first, with numbers for wordings
        known = F.broadcast(codes.select(F.col("text").alias("_text"), F.col("w").alias("_w")))
        rows = cut(rows.join(known, F.col("canonical_text").eqNullSafe(F.col("_text"))).drop("canonical_text", "content_hash", "_text"))
        order = (F.desc("priority_score"), F.asc("session_id"), F.asc("_w"))
        # as orderBy, but that wordings come back before a task sorts: Spark drops a sort below a join
        rows = rows.repartitionByRange(*order).join(known, "_w").sortWithinPartitions(*order).withColumnRenamed("_text", "canonical_text")
    else:
        rows = rows.orderBy(F.desc("priority_score"), "session_id", "content_hash")
    late(rows).select(*[F.col(c).alias(h) for c, h in CSV_HEADERS.items()]).write.option("header", True).csv(path)


def session_documents(analytics: DataFrame) -> DataFrame:
    """A10: one JSON document a session from its analytics."""
    return analytics.select("session_id", F.to_json(F.struct(*[c for c in analytics.columns if c != "session_id"]), {"ignoreNullFields": "false"}).alias("analytics_json"))


class Slices:
    """A table of slices (values of the column `by`) that are rebuilt whole: what a rebuild gives takes the place of what was there, and a slice that it leaves empty is empty.

    A rebuild writes its rows as a new version beside the old ones. A manifest of all slices and their versions is then written aside and renamed into place, which is
    the moment from which readers see all of the rebuild; until then, or if it fails, they see none of it. Of two rebuilds at a time the second one to
    finish is refused and may be run again. Versions that no slice has any more are removed by `vacuum`.
    """

    def __init__(self, spark: SparkSession, path: str, by: str):
        self.spark, self.path, self.by = spark, path, by
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _latest(self) -> int:
        """The number of the manifest in force; -1 before the first rebuild."""
        folder = self._path(f"{self.path}/manifest")
        if not self._files.exists(folder):
            return -1
        return max([int(x.getPath().getName()) for x in self._files.listStatus(folder)], default=-1)

    def _manifest(self, number: int) -> DataFrame:
        """The slices and the version of each."""
        return self.spark.read.parquet(f"{self.path}/manifest/{number}")

    def rebuild(self, rows: DataFrame, slices: DataFrame) -> None:
        """Puts rows in place of all that the slices (a table with the column `by`) have; rows of other slices are passed over. A null slice is a slice."""
        before, by = self._latest(), self.by
        number = before + 1
        rebuilt = slices.select(F.col(by).alias("_slice")).distinct()
        inside = rows.join(rebuilt, F.col(by).eqNullSafe(F.col("_slice")), "left_semi")
        aside = f"{uuid.uuid4().hex}"
        inside.write.parquet(f"{self.path}/data/{number}-{aside}")
        marked = rebuilt.select(F.col("_slice").alias(by), F.lit(f"{number}-{aside}").alias("version"))
        if before >= 0:
            kept = self._manifest(before).join(rebuilt, F.col(by).eqNullSafe(F.col("_slice")), "left_anti")
            marked = kept.unionByName(marked)
        marked.write.parquet(f"{self.path}/aside/{aside}")
        self._files.mkdirs(self._path(f"{self.path}/manifest"))
        target = self._path(f"{self.path}/manifest/{number}")
        # a rename onto a folder that is there would move into it
        if self._files.exists(target) or not self._files.rename(self._path(f"{self.path}/aside/{aside}"), target):
            raise RuntimeError(f"another rebuild of {self.path} came first")

    def _versions(self, number: int) -> list[str]:
        """One name for each rebuild that still has a slice."""
        return sorted(r.version for r in self._manifest(number).select("version").distinct().collect())

    def read(self) -> DataFrame:
        """The rows of all slices. Only versions in force are read."""
        number = self._latest()
        if number < 0:
            raise ValueError(f"nothing was written to {self.path}")
        parts = [self.spark.read.parquet(f"{self.path}/data/{v}").withColumn("_version", F.lit(v)) for v in self._versions(number)]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part, allowMissingColumns=True)
        live = self._manifest(number).select(F.col(self.by).alias("_slice"), "version")
        return rows.join(live, F.col(self.by).eqNullSafe(F.col("_slice")) & (F.col("_version") == F.col("version")), "left_semi").drop("_version")

    def vacuum(self) -> None:
        """Removes versions and manifests that aren't in force; not while a reader or a rebuild is at work."""
        number = self._latest()
        live = set(self._versions(number))
        for kind, kept in (("data", live), ("manifest", {str(number)}), ("aside", set())):
            folder = self._path(f"{self.path}/{kind}")
            for x in self._files.listStatus(folder) if self._files.exists(folder) else []:
                if x.getPath().getName() not in kept:
                    self._files.delete(x.getPath(), True)
