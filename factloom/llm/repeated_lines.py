"""Lines repeated across the documents of one source, counted incrementally."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import latest, paths, put_text, shared_dir, written

#: Files of one issuer in which a line must stand to count as repeated.
MIN_FILES = 12
#: Parts of the count tables, by a hash of the source, and tables of deltas that are merged into one when they are more.
BUCKETS, COMPACT = 16, 8
#: Deltas that a whole table is merged in by the queries.
DELTAS = 4
#: All white space (the Unicode property) and the digits 0-9; the same for texts of ASCII alone.
_LEFT_OUT = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}0-9]+"
_LEFT_OUT_ASCII = r"[\s\x1C-\x1F0-9]+"

KEY = ["bucket", "source", "h1", "h2"]


def issuer_of(source_file: Column) -> Column:
    return F.substring_index(source_file, "/", 1)


def line_of(text: Column) -> Column:
    """What two texts must share to be one line."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.lower(F.when(ascii_only, F.regexp_replace(text, _LEFT_OUT_ASCII, "")).otherwise(F.regexp_replace(text, _LEFT_OUT, "")))


def delta_of(source_file: Column, deltas: int = DELTAS) -> Column:
    """The delta a file comes with when a whole table is merged in several: by a digit of a hash of its name."""
    return ((F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.coalesce(source_file, F.lit(""))), 1, 1)) - 1) % deltas).cast("int")


def lines_of(elements: DataFrame, deltas: int = DELTAS) -> DataFrame:
    """(element_id, source_file, file, bucket, source, h1, h2, delta): narrow rows of the elements that hold a line.

    Later steps read them in place of the texts. h1 and h2 are 128 bits of the line, file 64 of its file's name.
    """
    e = elements.where("element_id is not null and source_file is not null and text is not null")
    lines = e.select("element_id", "source_file", line_of(F.col("text")).alias("line")).where("line <> ''")
    source = issuer_of(F.col("source_file"))
    return lines.select(
        "element_id", "source_file", F.xxhash64("source_file").alias("file"), F.pmod(F.xxhash64(source), F.lit(BUCKETS)).cast("int").alias("bucket"), source.alias("source"),
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), delta_of(F.col("source_file"), deltas).alias("delta"),
    )


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


class LineCounts:
    """Tables of each source's lines in a folder, kept up to date by merging new partitions of elements as deltas.

    pairs holds the distinct (line, file) pairs that a delta was the first to bring, counts how many files a delta added to a
    line. Both are sorted by a hash of the source, so a delta only reads the parts of the sources it holds. A manifest
    names the tables that count; a later session opens the folder and goes on. Beyond COMPACT tables they are merged.
    A delta whose write was cut short is not in the manifest and is merged again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, min_files: int = MIN_FILES) -> None:
        self.spark, self.min_files = spark, min_files
        self.path = path or f"{shared_dir(spark)}/line-counts-{uuid.uuid4().hex}"
        manifests = paths(spark, f"{self.path}/manifest-?????????") if path else []
        self.version = int(manifests[-1].rsplit("-", 1)[1]) if manifests else 0
        self.deltas: list[str] = [r.value for r in spark.read.text(manifests[-1]).collect()] if manifests else []

    def _read(self, kind: str, buckets: list[int] | None = None) -> DataFrame | None:
        """The tables of a kind, of some buckets only: files are sorted by bucket, so the scan skips other row groups."""
        if not self.deltas:
            return None
        schema = "bucket int, source string, h1 bigint, h2 bigint, " + ("file bigint" if kind == "pairs" else "n_files bigint")
        df = _union([self.spark.read.schema(schema).parquet(f"{self.path}/{kind}-{d}") for d in self.deltas])
        return df if buckets is None else df.where(F.col("bucket").isin(buckets))

    def _write(self, df: DataFrame, kind: str, name: str) -> DataFrame:
        df.sortWithinPartitions("bucket").write.parquet(f"{self.path}/{kind}-{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{kind}-{name}")

    def _commit(self, deltas: list[str]) -> None:
        self.version += 1
        put_text(self.spark, f"{self.path}/manifest-{self.version:09d}", "\n".join(deltas))
        self.deltas = deltas

    def merge(self, lines: DataFrame) -> DataFrame:
        """Add a delta from lines_of(); returns (bucket, source, h1, h2, n_files) of the lines it made reach the threshold.

        A file that comes again in a later delta counts once, and merging a delta twice changes nothing. Pairs are
        made distinct and counts summed before each shuffle, so neither a line nor a source with very many rows
        makes a large task. An empty delta changes nothing.
        """
        new = lines.select(*KEY, "file").distinct()
        buckets = [r.bucket for r in lines.select("bucket").distinct().collect()]
        seen, counts = self._read("pairs", buckets), self._read("counts", buckets)
        name = f"{self.version + 1:09d}-{uuid.uuid4().hex[:8]}"
        if seen is not None:
            new = new.join(seen, [*KEY, "file"], "left_anti")
        pairs = self._write(new, "pairs", name)
        counted = self._write(pairs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_files")), "counts", name)
        after = counted.withColumn("n_before", F.lit(0).cast("bigint"))
        if counts is not None:
            before = counts.join(counted.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.sum("n_files").alias("n_before"))
            after = counted.join(before, KEY, "left").withColumn("n_before", F.coalesce("n_before", F.lit(0)))
        total = F.col("n_before") + F.col("n_files")
        crossed = written(after.where((F.col("n_before") < self.min_files) & (total >= self.min_files)).select(*KEY, total.alias("n_files")), "crossed")
        self._commit([*self.deltas, name])
        if len(self.deltas) > COMPACT:
            self.compact()
        return crossed

    def compact(self) -> None:
        """All tables merged into one of each kind; the former stay readable until their folder is removed."""
        name = f"{self.version + 1:09d}-{uuid.uuid4().hex[:8]}"
        self._write(self._read("pairs"), "pairs", name)
        self._write(self._read("counts").groupBy(*KEY).agg(F.sum("n_files").alias("n_files")), "counts", name)
        self._commit([name])

    def repeated(self) -> DataFrame:
        """(bucket, source, h1, h2, n_files) of all lines that have reached the threshold so far."""
        none = self.spark.createDataFrame([], "bucket int, source string, h1 bigint, h2 bigint, n_files bigint")
        return (self._read("counts") if self.deltas else none).groupBy(*KEY).agg(F.sum("n_files").alias("n_files")).where(F.col("n_files") >= self.min_files)


def _merged(elements: DataFrame, min_files: int, deltas: int) -> tuple[DataFrame, list[DataFrame]]:
    """The lines of a table, written by delta, and for each delta the lines that crossed the threshold with it."""
    lines = lines_of(elements, deltas)
    path = f"{shared_dir(elements.sparkSession)}/lines-{uuid.uuid4().hex}"
    lines.write.partitionBy("delta").parquet(path)
    lines = elements.sparkSession.read.schema(lines.schema).parquet(path)
    state = LineCounts(elements.sparkSession, min_files=min_files)
    return lines, [state.merge(lines.where(F.col("delta") == d)).select(*KEY) for d in range(deltas)]


def repeated_elements(elements: DataFrame, min_files: int = MIN_FILES, deltas: int = DELTAS) -> DataFrame:
    """(element_id): each element whose text is a line of at least min_files files of its issuer, once.

    The table's files are merged in so many deltas; the elements are those that hold a line that crossed the threshold in
    one of them. Elements with a null source_file or element_id, and texts with nothing but white space and digits (null
    ones too), are neither counted nor found. Repeated rows of an element count once. The empty table gives no rows.
    """
    lines, crossed = _merged(elements, min_files, deltas)
    # The written tables' size is known to the planner: they are broadcast only below the session's limit.
    return lines.join(_union(crossed), KEY, "left_semi").select("element_id").distinct()


def without_repeated(elements: DataFrame, min_files: int = MIN_FILES) -> DataFrame:
    """The elements that are not found by repeated_elements(), one row for each element_id (its last loaded one), all columns kept."""
    found = written(repeated_elements(elements, min_files), "found")
    return latest(elements.join(found, "element_id", "left_anti").select(*elements.columns), "element_id")


def rebuilt_documents(elements: DataFrame, min_files: int = MIN_FILES, deltas: int = DELTAS) -> DataFrame:
    """The elements' columns after delta: for each delta, the remaining elements of the documents it makes build anew, and of no others.

    Those are the delta's own documents, and earlier ones that hold a line which crosses the threshold in this delta. An
    element is left out if one of its rows holds a line repeated by then; of its rows the last loaded is kept. The rows of a
    document's last delta are its clean text, so all of them together are without_repeated(). A document none of whose
    elements remain has no rows; elements of a null source_file are one document, which is never built anew.
    """
    lines, crossed = _merged(elements, min_files, deltas)
    one = latest(elements, "element_id").withColumn("_own", delta_of(F.col("source_file"), deltas))
    hit = written(_union([lines.join(c, KEY, "left_semi").select("element_id", "source_file", F.greatest("delta", F.lit(d)).alias("at")) for d, c in enumerate(crossed)]), "hits")
    gone = hit.groupBy("element_id").agg(F.min("at").alias("_gone"))
    placed = one.select("element_id", F.col("source_file").alias("_file"), F.col("_own").alias("_at"))
    # When each document is built: with its own delta, and whenever one of its elements falls out.
    falls = placed.join(gone, "element_id").select("_file", F.greatest("_gone", "_at").alias("at"))
    built = placed.select("_file", F.col("_at").alias("at")).unionByName(falls).distinct()
    times = written(built.groupBy("_file").agg(F.sort_array(F.collect_set("at")).alias("_times")), "times")
    kept = one.join(gone, "element_id", "left").withColumn("_file", F.col("source_file"))
    known = kept.join(times.withColumnRenamed("_file", "_f"), F.col("_file").eqNullSafe(F.col("_f")))
    each = known.select(F.explode("_times").alias("delta"), *elements.columns, "_gone")
    return each.where("_gone is null or _gone > delta").drop("_gone")
