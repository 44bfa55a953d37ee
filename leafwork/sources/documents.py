"""One named file a document, all of a run or none.

A Python data source writes the files.  Tasks write theirs to a staging folder of their own; once all tasks are done, the
driver moves each folder of files into the run's folder (first phase), and the pointer beside it is then swapped to name that
run (second phase).  A task that is killed leaves only staging behind, which no reader sees and the next commit removes.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions import text as T
from .versions import POINTER, Folder

NAME = "named_files"
#: What the name of each kind of file ends in.
ENDINGS = {"markdown": "_translated_embedded.md", "html": "_translated.html", "summary": "_summary.md", "json": "_structured.json", "xlsx": "_tables.xlsx"}


def _file_system(path: str):
    """A file system and the path on it, for tasks: local paths, file: and whatever else Arrow can open."""
    if "://" not in path and path.startswith("file:"):
        path = path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    buckets: list[str]
    files: int


class _Files(DataSourceArrowWriter):
    def __init__(self, path: str, run: str):
        self.path, self.run = path.rstrip("/"), run

    def write(self, iterator):
        fs, root = _file_system(self.path)
        own = f".staging-{self.run}/{uuid.uuid4().hex}"
        made, files = set(), 0
        for batch in iterator:
            for bucket, name, content in zip(*(batch.column(c).to_pylist() for c in ("bucket", "name", "content"))):
                if bucket not in made:
                    fs.create_dir(f"{root}/{own}/{bucket}", recursive=True)
                    made.add(bucket)
                with fs.open_output_stream(f"{root}/{own}/{bucket}/{name}") as out:
                    out.write(content)
                files += 1
        return Written(own, sorted(made), files)

    def commit(self, messages) -> None:
        fs, root = _file_system(self.path)
        fs.create_dir(f"{root}/run-{self.run}", recursive=True)
        for m in messages:
            for bucket in m.buckets if m is not None else ():
                target = f"{root}/run-{self.run}/{bucket}"
                if fs.get_file_info(target).type == pafs.FileType.NotFound:
                    fs.move(f"{root}/{m.folder}/{bucket}", target)
                else:  # rows of one bucket came from several tasks
                    for f in fs.get_file_info(pafs.FileSelector(f"{root}/{m.folder}/{bucket}")):
                        fs.move(f.path, f"{target}/{f.base_name}")
        self._clear(fs, root)

    def abort(self, messages) -> None:
        self._clear(*_file_system(self.path))

    def _clear(self, fs, root) -> None:
        for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if f.base_name == f".staging-{self.run}":
                fs.delete_dir(f.path)


class NamedFiles(DataSource):
    """Rows (bucket string, name string, content binary) as files ``run-<run>/<bucket>/<name>`` under a path."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "bucket string, name string, content binary"

    def writer(self, schema, overwrite):
        return _Files(self.options["path"], self.options["run"])


def file_names(title: str | F.Column, doc_id: F.Column, ending: str) -> F.Column:
    """The slug of a title and eight digits of the id's hash, so that equal titles stay apart; long slugs are cut at 80 characters."""
    key = F.substring(F.sha2(doc_id.cast("string").cast("binary"), 256), 1, 8)
    return F.concat(F.left(T.safe_slug(F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit(""))), F.lit(80)), F.lit("_"), key, F.lit(ending))


def write_documents(rows: DataFrame, content: str, path: str, title: F.Column | str | None = None, ending: str = ".txt", buckets: int = 64, append: bool = False) -> str:
    """Write the column ``content`` (text or binary) of rows keyed by doc_id as one file each; gives the run's id.

    Names are the slug of the title (``paper`` if there is none) with a hash of the id; rows without an id or content are left
    out, and of rows that repeat an id the one with the greatest content stays.  Readers see the files of this run after its
    commit, with ``append`` beside those of the runs before it: there the last run's file of a name counts.
    """
    spark = rows.sparkSession
    spark.dataSource.register(NamedFiles)
    title = F.lit("paper") if title is None else F.col(title) if isinstance(title, str) else title
    value = F.col(content).cast("binary")
    picked = rows.select(F.col("doc_id").cast("string").alias("doc"), title.alias("title"), value.alias("content")).where("doc is not null and content is not null")
    picked = picked.groupBy("doc").agg(F.max(F.struct("content", "title")).alias("r")).select("doc", "r.*")
    bucket = F.lpad(F.hex(F.pmod(F.xxhash64("doc"), F.lit(buckets))), 2, "0")
    files = picked.select(F.lower(bucket).alias("bucket"), file_names("title", F.col("doc"), ending).alias("name"), "content")
    run = uuid.uuid4().hex
    folder = Folder(spark, path)
    folder.make()
    files.repartition("bucket").write.format(NAME).option("path", path).option("run", run).mode("append").save()
    _publish(folder, run, append)
    return run


def _publish(folder: Folder, run: str, append: bool) -> None:
    old = json.loads(folder.read(POINTER))["runs"] if folder.exists(POINTER) else []
    folder.swap(POINTER, json.dumps({"runs": [*old, run] if append else [run]}))
    if not append:
        for r in old:
            folder.delete(f"run-{r}")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, content) of the files that count; Spark passes over empty ones."""
    folder = Folder(spark, path)
    runs = json.loads(folder.read(POINTER))["runs"]
    have = [r for r in runs if folder.exists(f"run-{r}")]
    paths = [f"{folder.path}/run-{r}/*" for r in have if folder.names(f"run-{r}")]
    if not paths:
        return spark.createDataFrame([], "name string, path string, content binary")
    files = spark.read.format("binaryFile").load(paths)
    nth = F.create_map(*[x for i, r in enumerate(have) for x in (F.lit(r), F.lit(i))])
    rows = files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "path", "content", nth[F.regexp_extract("path", r"/run-([0-9a-f]+)/", 1)].alias("n"))
    return rows.groupBy("name").agg(F.max_by(F.struct("path", "content"), "n").alias("r")).select("name", "r.*")
