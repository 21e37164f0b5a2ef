"""Sources and sinks: delimited and line files with strictness, zip archives, directories, HTML tables, XML, SQLite, JDBC, commands, split output."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkloom.functions.text import col, strsplitv


def file(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = False, strict: int = 1, names: list[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A file or folder as text columns C1..Cn, or named by `names` or the header; without a delimiter one row a line.

    'NULL' in any case is NULL. Lines of another width than the names raise (strict 1), are dropped
    (0), or are all that is returned, as (foundcols, expectedcols, contents) (-1). Compressed files
    are read by their extension. With `header` each file's first line is left out; the first file's names
    the columns. One plan serves all three, so nothing is read twice but the header.
    """
    lines = spark.read.option("encoding", encoding).text(path)
    if delimiter is None:
        return lines.toDF("C1")
    if header or names is None:
        first = lines.first()
        cells = [] if first is None else spark.createDataFrame([first], "value string").select(strsplitv("value", delimiter)).first()[0]
        names = names or (cells if header else [f"C{i + 1}" for i in range(len(cells))])
        if header and first is not None:
            # the reader drops the first line of every file, and no other line like it
            lines = spark.read.schema("value string").options(header="true", sep="\x01", quote="", escape="", nullValue="\x02", emptyValue="", encoding=encoding).csv(path)
    cut = lines.select("value", strsplitv("value", delimiter).alias("c"))
    good = F.size("c") == len(names)
    if strict < 0:
        return cut.where(~good).select(F.size("c").alias("foundcols"), F.lit(len(names)).alias("expectedcols"), F.col("value").alias("contents"))
    if strict:
        message = F.concat(F.lit(f"expected {len(names)} columns: "), F.col("value"))
        cut = cut.withColumn("c", F.when(good, F.col("c")).otherwise(F.raise_error(message)))
    else:
        cut = cut.where(good)
    value = lambda i: F.when(F.upper(F.get("c", i)) != "NULL", F.get("c", i))
    return cut.select(*[value(i).alias(n) for i, n in enumerate(names)])


def filetext(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, one a row."""
    return spark.read.text(path, wholetext=True).toDF("text")


def dirfiles(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(c1 path, c2 name) of the files in a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select(F.col("path").alias("c1"))
    return found.withColumn("c2", F.element_at(F.split("c1", "/"), -1))


def ziplines(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, line) of the text members of zip archives; an archive is one task's work."""

    def run(batches):
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        with z.open(name) as f:
                            lines = io.TextIOWrapper(f, "utf-8")
                            while chunk := [x.rstrip("\n") for _, x in zip(range(10_000), lines)]:
                                yield pd.DataFrame({"path": where, "name": name, "line": chunk})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, name string, line string")


def html_tables(html: str) -> list[list[list[str]]]:
    """The tables of a page, each as rows of cell texts; nested tables come after the one around them."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.tables, self.open, self.cell = [], [], None

        def handle_starttag(self, tag, attrs):
            if tag == "table":
                self.tables.append([])
                self.open.append(self.tables[-1])
            elif tag == "tr" and self.open:
                self.open[-1].append([])
            elif tag in ("td", "th") and self.open:
                if not self.open[-1]:
                    self.open[-1].append([])
                self.open[-1][-1].append("")
                self.cell = self.open[-1][-1]

        def handle_endtag(self, tag):
            if tag == "table" and self.open:
                self.open.pop()
            if tag in ("td", "th", "table"):
                self.cell = None

        def handle_data(self, data):
            if self.cell is not None:
                self.cell[-1] = re.sub(r"\s+", " ", self.cell[-1] + data).strip(" ")

    reader = Reader()
    reader.feed(html)
    return reader.tables


def webtable(df: DataFrame, html: str, n: int = 1) -> Column:
    """An array of rows (arrays of cell texts) of the n-th table of each page; NULL where there is none."""

    @F.pandas_udf("array<array<string>>")
    def run(s):
        def one(t):
            found = html_tables(t or "")
            return found[n - 1] if len(found) >= n else None

        return s.map(one)

    return run(df[html])


def xmlparse(df: DataFrame, text: str, schema: str, strict: int = 1) -> DataFrame:
    """One row per XML document in `text`, with the schema's columns; missing texts are empty, repeated ones (array columns) joined by tabs.

    strict 1 raises on broken documents, 0 drops them, -1 returns them alone as they stand.
    """
    from pyspark.sql.types import ArrayType, StructType

    fields = StructType.fromDDL(schema).fields
    mode = {1: "FAILFAST"}.get(strict, "PERMISSIVE")
    parsed = F.from_xml(col(text), schema + ("" if strict == 1 else ", _corrupt_record string"), {"mode": mode, "columnNameOfCorruptRecord": "_corrupt_record"})
    made = df.select(F.col(text).alias("_t"), parsed.alias("_x"))
    if strict < 1:
        broken = F.col("_x._corrupt_record").isNotNull()
        if strict < 0:
            return made.where(broken).select(F.col("_t").alias("line"))
        made = made.where(~broken)
    cell = lambda f: F.array_join(F.col(f"_x.{f.name}"), "\t") if isinstance(f.dataType, ArrayType) else F.col(f"_x.{f.name}").cast("string")
    return made.select(*[F.coalesce(cell(f), F.lit("")).alias(f.name) for f in fields])


class SqliteSource(DataSource):
    """spark.read.format("sqlite").option("db", path).option("query", sql): a query of a SQLite file, run once by one task."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        import sqlite3

        kinds = {int: "bigint", float: "double", bytes: "binary"}
        with sqlite3.connect(f"file:{self.options['db']}?mode=ro", uri=True) as c:
            found = c.execute(self.options["query"])
            row = found.fetchone() or [None] * len(found.description)
            return ", ".join(f"`{d[0]}` {kinds.get(type(v), 'string')}" for d, v in zip(found.description, row, strict=True))

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, [f.dataType.simpleString() for f in schema.fields])


class SqliteReader(DataSourceReader):
    def __init__(self, options, kinds):
        self.db, self.query, self.kinds = options["db"], options["query"], kinds

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        import sqlite3

        make = {"bigint": lambda v: int(v), "double": float, "binary": bytes}
        with sqlite3.connect(f"file:{self.db}?mode=ro", uri=True) as c:
            for row in c.execute(self.query):
                yield tuple(None if v is None else make.get(k, str)(v) for v, k in zip(row, self.kinds, strict=True))


def sqlite(spark: SparkSession, db: str, query: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("db", db).option("query", query).load()


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query of a remote database (MySQL, PostgreSQL, Oracle ...); the driver's JAR must be on the class path. Give partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def unionalldb(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """A folder of parts part=N as one table; parts outside [start, end) are pruned before the scan."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where(F.col("part") >= start)
    return df if end is None else df.where(F.col("part") < end)


def pipe(spark: SparkSession, command: list[str]) -> DataFrame:
    """The lines that a command prints on the driver, as C1. Opt-in: it starts a process."""
    import subprocess

    out = subprocess.run(command, capture_output=True, check=True, text=True).stdout
    return spark.createDataFrame([(x,) for x in out.splitlines()], "C1 string")


def jsonpipe(spark: SparkSession, command: list[str], schema: str) -> DataFrame:
    """As pipe, for lines of JSON objects."""
    return pipe(spark, command).select(F.from_json("C1", schema).alias("j")).select("j.*")


def stdinput(spark: SparkSession) -> DataFrame:
    import sys

    return spark.createDataFrame([(x.rstrip("\n"),) for x in sys.stdin], "C1 string")


def output(df: DataFrame, path: str, mode: str | None = None, header: bool = False, append: bool = False, compression: str | None = None, split: int | list[str] | None = None, orderby: list[str] | None = None, single: bool = False) -> None:
    """Writes df as plain, tsv, csv, json or parquet, by `mode` or the path's extension.

    split: columns make folders by key, a number makes that many files by the first column.
    """
    kind = mode or {"tsv": "tsv", "csv": "csv", "json": "json", "parquet": "parquet"}.get(path.rsplit(".", 1)[-1], "plain")
    if isinstance(split, int):
        df = df.repartition(split, df.columns[0])
    elif single:
        df = df.coalesce(1)
    if orderby:
        df = df.sortWithinPartitions(*orderby)
    writer = df.write.mode("append" if append else "overwrite")
    if isinstance(split, list):
        writer = writer.partitionBy(*split)
    if compression:
        writer = writer.option("compression", compression)
    if kind in ("csv", "tsv"):
        writer.option("header", header).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    elif kind == "json":
        writer.json(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        writer.text(path)
