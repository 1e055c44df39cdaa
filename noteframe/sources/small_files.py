"""Folders of very many small files (A5, A13, A14): a task writes or reads thousands of them.

On a local file system Hadoop starts a process for each file it makes, and
Spark lists a folder with a task for every few entries and reads some thirty
files a task. Here tasks make and read the files themselves. Other file systems,
and folders of few entries, take Spark's writers and readers; both ways make
and read the same bytes.
"""

from __future__ import annotations

import fnmatch
import os
import re
import shutil
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: entries of a folder that make it one of many files, and entries that a task reads
MANY, ENTRIES = 1_000, 2_000
#: what Spark writes in a folder's name where the value is null or empty, and the signs that it escapes
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = "".join(map(chr, range(1, 32))) + "\x7f\"#%'*/:=?\\{[]^"


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path on this machine's file system, None if it is on another."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    here = p.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
    return os.path.abspath(p.toUri().getPath()) if here else None


def write_folders(df: DataFrame, root: str, keys: Sequence[str], line: Column, order: Sequence[str] = (), header: str | None = None,
                  end: str = ".txt") -> int:
    """A folder per value of ``keys`` below the local path ``root``, which is replaced; in it one file: ``header``, then the
    lines in ``order``. The number of files.

    A file gets its name when it is whole, the same one in every try of a task."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if os.path.lexists(root):
        shutil.rmtree(root)
    os.makedirs(root)
    escape = {ord(c): f"%{ord(c):02X}" for c in ESCAPED}
    names = [k.translate(escape) for k in keys]
    first = b"" if header is None else header.encode() + b"\n"

    def run(batches):
        from pyspark import TaskContext
        task = TaskContext.get()
        at, out, now, made = None, None, None, 0

        def close():
            if out is not None:
                out.close()
                os.replace(out.name, at)
        for b in batches:
            for *key, text in zip(*[c.to_pylist() for c in b.columns]):
                if key != now or out is None:
                    close()
                    folder = "/".join([root, *[f"{n}={v.translate(escape) if v else NO_VALUE}" for n, v in zip(names, key)]])
                    os.makedirs(folder, exist_ok=True)
                    at = f"{folder}/part-{task.partitionId():05d}{end}"
                    out = open(f"{folder}/.part-{task.partitionId():05d}-{task.taskAttemptId()}", "wb")
                    out.write(first)
                    now, made = key, made + 1
                out.write((text or b"") + b"\n")
        close()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], ["n"])
    # an empty value and none are one folder
    value = [F.when(F.col(k).cast("string") != "", F.col(k).cast("string")).alias(f"k{i}") for i, k in enumerate(keys)]
    by = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*value, line.cast("binary").alias("line"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    rows = rows.repartition(tasks, *by).sortWithinPartitions(*by, *[f"o{i}" for i in range(len(order))])
    n = rows.select(*by, "line").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    open(f"{root}/_SUCCESS", "w").close()
    return n


def folder_value(path: Column, key: str) -> Column:
    """The value of ``key`` in a path that :func:`write_folders` or Spark's writer has made."""
    from noteframe.sources.notes import decoded_path
    found = F.regexp_extract(path, rf"/{re.escape(key)}=([^/]*)/", 1)
    return F.when(found != NO_VALUE, decoded_path(found))


def read_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, at, value): the lines of all files below ``path`` whose name matches ``glob``; ``at`` grows within a file.

    Files that begin with ``_`` or ``.`` are none, as for Spark. In a folder of many entries a file is read by one task, as a stream."""
    from noteframe.sources.notes import decoded_path
    root = None if re.search(r"[\[\]{}\\]", glob) else local_path(spark, path)
    entries = sorted(e.name for e in os.scandir(root)) if root and os.path.isdir(root) else []
    if len(entries) < MANY:
        return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
                .select(decoded_path(F.col("_metadata.file_path")).alias("path"), F.monotonically_increasing_id().alias("at"), "value"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-len(entries) // ENTRIES))
    listed = spark.sparkContext.broadcast(entries)

    def seen(name):
        return not (name.startswith("_") and "=" not in name) and not name.startswith(".") and not name.endswith("._COPYING_")

    def files(name):
        full = f"{root}/{name}"
        if not os.path.isdir(full):
            yield full
            return
        for folder, below, names in os.walk(full, followlinks=True):
            below[:] = sorted(filter(seen, below))
            yield from (f"{folder}/{n}" for n in sorted(filter(seen, names)))

    def run(batches):
        def batch(held):
            paths, at, value = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(at, pa.int64()), pa.array(value, pa.binary())], ["path", "at", "value"])
        held = []
        for b in batches:
            for task in b.column(0).to_pylist():
                for name in filter(seen, listed.value[task::tasks]):
                    for file in files(name):
                        if not fnmatch.fnmatchcase(os.path.basename(file), glob):
                            continue
                        n = 0
                        with open(file, "rb") as lines:
                            for line in lines:  # ends at a line feed; a carriage return ends a line, too
                                line = line[:-2] if line.endswith(b"\r\n") else line[:-1] if line.endswith(b"\n") else line
                                for part in line.removesuffix(b"\r").split(b"\r") if b"\r" in line else [line]:
                                    held.append((f"file:{file}", n, part))
                                    n += 1
                                if len(held) >= 10_000:
                                    yield batch(held)
                                    held = []
        if held:
            yield batch(held)
    lines = spark.range(0, tasks, 1, tasks).mapInArrow(run, "path string, at long, value binary")
    return lines.select("path", "at", F.col("value").cast("string").alias("value"))
