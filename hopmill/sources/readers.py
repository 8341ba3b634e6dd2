"""Reading and writing of record files, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hopmill.operators.integrity import fingerprint


def read_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One JSON record on each line that is not blank; a line that does not fit raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_list(spark: SparkSession, path: str, field: str, item: str) -> DataFrame:
    """JSON documents that hold a list under a field: one row for each item. item is the DDL of one item."""
    rows = spark.read.schema(f"`{field}` array<struct<{item}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.explode(field).alias("_i")).select("_i.*")


def read_folder(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """One JSON result in each file of a folder, with file_path. Check repeated identities with integrity.repeated_keys."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*.json")
    return rows.select("*", F.col("_metadata.file_path").alias("file_path"))


def _cells(record: Column) -> Column:
    """The cells of a CSV record: quoted ones without their quotes, doubled quotes as one, nothing trimmed."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(r',((?:[^",]++|"[^"]*+(?:"|\z))*+)'), F.lit(1))
    inner = lambda c: F.transform(F.split(c, '"', -1), lambda p, i: F.when((p == "") & (i % 2 == 0) & (i > 0), '"').otherwise(p))
    # of the parts between quotes, an empty one outside (but the last) stands for a doubled quote
    text = lambda c: F.array_join(F.concat(F.slice(inner(c), F.lit(1), F.size(F.split(c, '"', -1)) - 1), F.array(F.element_at(F.split(c, '"', -1), -1))), "")
    return F.transform(cells, lambda c: F.when(c.startswith('"'), text(c)).otherwise(c))


def read_relations(spark: SparkSession, path: str, header: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of a relation library: head, tail, relation, label with a header, and a leading id without one.

    Files are CSV: quoted cells may hold commas, quotes (doubled) and line ends; nothing is trimmed. Records are numbered
    from 1 by file (source_row); a leading byte order mark goes, empty lines are skipped. A first record that is not the
    header is a violation (bad_header), and so is a record with another number of cells or an empty cell (bad_line). A
    library is one file, whose records are numbered in one pass of one task; libraries are small by their nature.
    """
    names = ["head", "tail", "relation", "label"] if header else ["id", "head", "tail", "relation", "label"]
    text = F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), "\r\n?", "\n")
    records = F.regexp_extract_all(text, F.lit(r'((?:[^"\n]++|"[^"]*+(?:"|\z))*+)(?:\n|\z)'), F.lit(1))
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.posexplode(records).alias("_n", "line"))
    rows = raw.select("file_path", (F.col("_n") + 1).alias("source_row"), "line").where("line <> ''").withColumn("_c", _cells(F.col("line")))
    top = F.lit(header) & (F.col("source_row") == 1)
    titles = F.col("_c") == F.array(*map(F.lit, names))
    good = (F.size("_c") == len(names)) & ~F.exists("_c", lambda x: x == "")
    check = F.when(top, F.when(~titles, "bad_header")).when(~good, "bad_line")
    bad = rows.withColumn("check", check).where("check is not null").select("check", F.concat_ws(":", "file_path", "source_row").alias("key"), F.col("line").alias("detail"))
    return rows.where(~top & good).select("file_path", "source_row", *(F.get("_c", F.lit(i)).alias(n) for i, n in enumerate(names))), bad


def write_projection(df: DataFrame, path: str, allowed: list[str]) -> None:
    """The allowed columns, one JSON record on each line."""
    df.select(*allowed).write.json(path)


def needs_prefix(text: Column) -> Column:
    """Whether a spreadsheet would read the text as a formula."""
    return F.coalesce(text.rlike(r"^[ \t\r\n]*[=+\-@]"), F.lit(False))


def spreadsheet_safe(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with an apostrophe before texts that a spreadsheet would run, and prefixed: whether any column got one."""
    flagged = df.withColumn("prefixed", F.greatest(*(needs_prefix(F.col(c)) for c in columns)) if len(columns) > 1 else needs_prefix(F.col(columns[0])))
    return flagged.withColumns({c: F.when(needs_prefix(F.col(c)), F.concat(F.lit("'"), c)).otherwise(F.col(c)) for c in columns})


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    spreadsheet_safe(df, columns).write.option("header", True).option("escape", '"').csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of each file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def manifest_violations(actual: DataFrame, stored: DataFrame) -> DataFrame:
    """(check, key): files that are missing, unexpected or changed against a stored manifest."""
    s = stored.select("path", F.col("sha256").alias("_s"), F.col("bytes").alias("_b"))
    check = F.when(F.col("sha256").isNull(), "missing").when(F.col("_s").isNull(), "unexpected").when((F.col("sha256") != F.col("_s")) | (F.col("bytes") != F.col("_b")), "changed")
    return actual.join(s, "path", "full").withColumn("check", check).where("check is not null").select("check", F.col("path").alias("key"))


def write_once(df: DataFrame, path: str) -> bool:
    """Write df unless the path holds a table: True if written, False if it holds the same rows; other rows raise."""
    spark = df.sparkSession
    try:
        there = spark.read.schema(df.schema).parquet(path)
        there.limit(1).count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.write.mode("errorifexists").parquet(path)
        return True
    if fingerprint(there).first() != fingerprint(df).first():
        raise ValueError(f"{path} holds other rows")
    return False


def registry(spark: SparkSession, path: str, pattern: str = r"^\W*(S\d{2})\W+(.+?)\s*$") -> DataFrame:
    """(id, title) from the lines of text files that match a pattern of two groups."""
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(F.regexp_extract("value", pattern, 1).alias("id"), F.regexp_extract("value", pattern, 2).alias("title"))
