"""Documents as words, tables and page texts: files read by Spark, pages parsed by a pluggable parser in the workers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "source_file string, page_number int, ord int, x0 double, y0 double, x1 double, y1 double, text string"
TABLES = "source_file string, page_number int, table_index int, rows array<array<string>>, bbox array<double>"
PAGES = "source_file string, page_number int, text string"
_PARTS = "part string, source_file string, page_number int, ord int, x0 double, y0 double, x1 double, y1 double, text string, rows array<array<string>>, bbox array<double>"


@dataclass
class Page:
    """A parsed page: its plain text, words as (x0, y0, x1, y1, text), tables as (rows, bbox)."""

    text: str = ""
    words: list[tuple[float, float, float, float, str]] = field(default_factory=list)
    tables: list[tuple[list[list[str | None]], list[float] | None]] = field(default_factory=list)


class PageParser(Protocol):
    """Turns a file's bytes into its pages in order; made once in a worker."""

    def pages(self, content: bytes) -> Iterable[Page]: ...


def files(spark: SparkSession, paths: list[str], suffix: str = ".pdf") -> DataFrame:
    """(source_file, content) of files or globs, as Spark's binary source reads them.

    A path of another suffix raises ValueError, one that matches nothing FileNotFoundError.
    """
    wrong = [p for p in paths if not p.lower().endswith(suffix)]
    if wrong:
        raise ValueError(f"not {suffix}: {', '.join(wrong)}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(conf).globStatus(path):
            raise FileNotFoundError(p)
    return spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "content")


def parse(files: DataFrame, make: Callable[[], PageParser]) -> DataFrame:
    """All parts of all pages: words, tables and texts in one table, so that a file is parsed once.

    A page whose tables fail to parse has none; a file that fails as a whole gives one row of part 'error'.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = make()
        names = [c.split()[0] for c in _PARTS.split(", ")]
        for batch in batches:
            for name, content in zip(batch["source_file"], batch["content"], strict=True):
                rows = []
                try:
                    for n, page in enumerate(parser.pages(bytes(content)), 1):
                        rows.append(("page", name, n, 0, None, None, None, None, page.text, None, None))
                        rows += [("word", name, n, i, *map(float, w[:4]), w[4], None, None) for i, w in enumerate(page.words)]
                        rows += [("table", name, n, i, None, None, None, None, None, t, b) for i, (t, b) in enumerate(page.tables, 1)]
                except Exception as e:  # noqa: BLE001
                    rows = [("error", name, 0, 0, None, None, None, None, f"{type(e).__name__}: {e}", None, None)]
                yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, _PARTS)


def words_of(parts: DataFrame) -> DataFrame:
    return parts.where("part = 'word'").select(*[c.split()[0] for c in WORDS.split(", ")])


def tables_of(parts: DataFrame) -> DataFrame:
    return parts.where("part = 'table'").select("source_file", "page_number", F.col("ord").alias("table_index"), "rows", "bbox")


def pages_of(parts: DataFrame) -> DataFrame:
    return parts.where("part = 'page'").select("source_file", "page_number", "text")
