"""A sink that writes trees as nested JSON, a line for each tree, by many tasks.

A tree's text is its concepts' pieces in the order of a walk: each piece opens a concept and closes those that end with
it. So the text needs no row that holds a whole tree: ranges of the walk are written by tasks of their own to hidden
files, and one commit gives them their names. The files, in order of their names, are the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from taxaspark.plans.evaluate import in_ranges

FORMAT = "nested_trees"


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str


class PieceWriter(DataSourceArrowWriter):
    """Writes the ``piece`` texts of each partition to a file; a task that fails, or a job, leaves nothing behind."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, iterator) -> Written:
        context = TaskContext.get()
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(f"{root}/_writing", recursive=True)
        file = f"{root}/_writing/{context.partitionId():08d}-{context.taskAttemptId()}"
        with system.open_output_stream(file) as out:
            for batch in iterator:
                for piece in batch["piece"].to_pylist():
                    out.write(piece.encode())
        return Written(context.partitionId(), file)

    def commit(self, messages) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        old = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.is_file]
        if old and not self.overwrite:
            self._clear()
            raise FileExistsError(f"{self.path} holds files")
        for f in old:
            system.delete_file(f)
        for m in messages:
            if m:
                system.move(m.file, f"{root}/part-{m.part:08d}.json")
        self._clear()
        system.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(f"{root}/_writing").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/_writing")


class NestedTrees(DataSource):
    """The sink's name and its writer; it takes rows of one column, ``piece``, in order of their partitions."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> PieceWriter:
        return PieceWriter(self.options["path"], overwrite)


def pieces(nodes: DataFrame) -> DataFrame:
    """tree, place, piece of each concept of ``nodes`` (tree, concept, depth, path, own: its JSON without braces and children).

    ``place`` orders a tree's concepts as a walk meets them, parents before children. Whether a piece needs a comma, and
    how many concepts it closes, follow from the depths of its neighbours in the walk.
    """
    place = F.array_join(F.transform("path", lambda x: F.lpad(x.cast("string"), 19, "0")), "/")
    rows = in_ranges(nodes.select("tree", place.alias("place"), "depth", "own"), "tree", "place")
    ends = rows.groupBy("_p").agg(F.min_by(F.struct("tree", "depth"), F.struct("tree", "place")).alias("first"), F.max_by(F.struct("tree", "depth"), F.struct("tree", "place")).alias("last"))
    order = Window.orderBy("_p")  # one row a range
    ends = ends.select("_p", F.lag("last").over(order).alias("_b"), F.lead("first").over(order).alias("_a"))
    walk = Window.partitionBy("_p").orderBy("tree", "place")
    here = F.struct("tree", "depth")
    rows = rows.withColumns({"_l": F.lag(here).over(walk), "_n": F.lead(here).over(walk)}).join(F.broadcast(ends), "_p")
    before, after = F.coalesce("_l", "_b"), F.coalesce("_n", "_a")
    comma = F.when((before["tree"] == F.col("tree")) & (before["depth"] >= F.col("depth")), ",").otherwise("")
    ends_tree = F.coalesce(after["tree"] != F.col("tree"), F.lit(True))
    closed = F.when(ends_tree, F.col("depth") + 1).otherwise(F.col("depth") + 1 - after["depth"])
    piece = F.concat(comma, F.lit("{"), "own", F.lit(',"children":['), F.repeat(F.lit("]}"), closed.cast("int")), F.when(ends_tree, "\n").otherwise(""))
    return rows.select("tree", "place", piece.alias("piece"))


def write_nested(nodes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes trees (``pieces``) as nested JSON under ``path``, a folder that the driver and all executors see."""
    nodes.sparkSession.dataSource.register(NestedTrees)
    rows = pieces(nodes).repartitionByRange("tree", "place").sortWithinPartitions("tree", "place")
    rows.select("piece").write.format(FORMAT).option("path", path).mode(mode).save()


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """json: the trees of a folder, one a row, put together from its files; a tree is as long as its text."""
    files = spark.read.text(f"{path}/part-*.json", wholetext=True).select("value", F.input_file_name().alias("file"))
    whole = files.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "value"))), lambda x: x["value"]), "").alias("all"))  # the files' texts
    return whole.select(F.explode(F.split("all", "\n")).alias("json")).filter("json <> ''")
