"""Line deduplication over levelled sorted runs.

Documents are dealt into batches by id. A batch's lines become entries (line hash, documents, greatest id); a
merge-anti-join against the runs written so far splits them into hashes never seen, which the batch adds as its own sorted
run, and repeats, which go to a log. When a level holds `fanout` runs they are compacted into one run of the next level.
Runs and log together give, for each line, the number of documents and the document that keeps it.

Only DataFrame functions run on the main path. A line that a third of all documents share is counted before it is shuffled
and joined back by an equi-join that adaptive execution can split.

Defined cases: a null or empty text is one empty line. Documents with the same id count as one document; each row keeps
its own text. A null id is a document of its own that ranks below all others. An empty table gives an empty result.
Further columns pass through `dedup_lines` untouched; its three own columns replace columns of the same name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelore.llm.store import new_path, remove, written
from voxelore.llm.text import BLANKS, ascii_lower


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def _lines(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)


def _row(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _stage(docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int) -> tuple[str, DataFrame]:
    """Narrow rows (id, row, pos, h, batch) of all lines long enough to have a key, in the shared folder."""
    path = new_path(docs.sparkSession, "lines")
    rows = docs.select(F.col(id_col).alias("id"), _row(id_col, text_col).alias("row"), F.posexplode(_lines(text_col)).alias("pos", "line"))
    rows = rows.select("id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    rows = rows.select("id", "row", "pos", F.unhex(F.md5(F.col("key").cast("binary"))).alias("h"), F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch"))
    schema = rows.schema
    rows.write.partitionBy("batch").parquet(path)
    return path, docs.sparkSession.read.schema(schema).parquet(path)


def _merged(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, runs)


class LineRuns:
    """The levelled runs: `add` takes a batch's entries (h, n_docs, max_id), `totals` merges runs and log."""

    def __init__(self, spark, fanout: int = 2):
        self.spark, self.fanout, self.levels, self.log = spark, fanout, [], []

    def _write_run(self, df: DataFrame) -> tuple[str, DataFrame]:
        path = new_path(self.spark, "line-run")
        return path, written(df.repartition(F.col("h")).sortWithinPartitions("h"), "line-run", path)

    def add(self, batch: DataFrame) -> None:
        batch = written(batch, "line-batch")
        runs = [run for level in self.levels for _, run in level]
        seen = _merged(runs).select("h") if runs else None
        own = batch.join(seen, "h", "left_anti") if runs else batch
        if runs:
            self.log.append(written(batch.join(seen, "h", "left_semi"), "line-log"))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write_run(own))
        self._compact()

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) < self.fanout:
                continue
            if k + 1 == len(self.levels):
                self.levels.append([])
            # Runs hold disjoint hashes, so that merging is a sorted union.
            self.levels[k + 1].append(self._write_run(_merged([run for _, run in level])))
            remove(self.spark, *(path for path, _ in level))
            level.clear()

    def totals(self) -> DataFrame:
        runs = [run for level in self.levels for _, run in level]
        return _merged([*runs, *self.log]).groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.max("max_id").alias("max_id"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """docs with the columns kept_text, n_lines (before) and n_dropped added."""
    spark = docs.sparkSession
    path, lines = _stage(docs, id_col, text_col, min_chars, batches)
    runs = LineRuns(spark, fanout)
    for k in range(batches):
        part = lines.where(F.col("batch") == k).select("h", "id").distinct()
        runs.add(part.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("max_id")))
    common = written(runs.totals().where(F.col("n_docs") >= min_docs).select("h", "max_id"), "line-common")
    drops = lines.join(common, "h").where(~F.col("id").eqNullSafe(F.col("max_id")))
    drops = written(drops.groupBy("id", "row").agg(F.collect_set("pos").alias("positions")), "line-drops")
    lead = "__"
    while any(c.startswith(lead) for c in docs.columns):
        lead += "_"
    of_id, of_row, at, parts = (lead + n for n in ("id", "row", "positions", "lines"))
    drops = drops.select(F.col("id").alias(of_id), F.col("row").alias(of_row), F.col("positions").alias(at))
    out = docs.join(drops, docs[id_col].eqNullSafe(drops[of_id]) & (_row(id_col, text_col) == drops[of_row]), "left")
    out = out.withColumn(parts, _lines(text_col))
    every = F.sequence(F.lit(0), F.size(parts) - 1)
    stay = F.array_except(every, F.col(at))
    kept = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    none = F.col(at).isNull()
    return out.select(
        *[F.col(c) for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")],
        F.when(none, F.coalesce(F.col(text_col), F.lit(""))).otherwise(kept).alias("kept_text"),
        F.size(parts).cast("long").alias("n_lines"),
        F.when(none, F.lit(0)).otherwise(F.size(at)).cast("long").alias("n_dropped"),
    )
