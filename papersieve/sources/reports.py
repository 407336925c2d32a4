"""Reading report tables back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papersieve.schema import header_type
from papersieve.sources.runs import RUN_ID, snapshot, valid_rows

DOC_ID = T.StructType([T.StructField("doc_id", T.LongType())])


def _read(
    spark: SparkSession, path: str, columns: T.StructType, source: str, options: dict[str, str]
) -> DataFrame:
    """Named columns of a written table, of the runs that count; no rows where none was written.

    The commits beside the table tell which runs count, as of now.
    """
    run = T.StructField(RUN_ID, T.StringType())
    known = columns if RUN_ID in columns.names else T.StructType([*columns.fields, run])
    try:
        rows = spark.read.format(source).schema(known).options(**options).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)
    valid = valid_rows(rows, path.rstrip("/").rpartition("/")[0])
    return valid.select(*[f"`{name}`" for name in columns.names])


def read_report(
    spark: SparkSession,
    path: str,
    header: list[str],
    keys: T.StructType | None = None,
    source: str = "parquet",
    options: dict[str, str] | None = None,
) -> DataFrame:
    """A written report: the ``keys`` if any, then its header columns."""
    columns = T.StructType([*(keys or T.StructType()).fields, *header_type(header).fields])
    return _read(spark, path, columns, source, options or {})


def read_manifest(
    spark: SparkSession,
    path: str,
    keys: T.StructType = DOC_ID,
    source: str = "parquet",
    options: dict[str, str] | None = None,
) -> DataFrame:
    """The manifest of all runs so far, as ``run_review`` takes it for ``earlier``.

    Only the columns that tell what is decided, so that little is read. Giving
    their types keeps ``run_ts`` text.
    """
    text = T.StringType()
    columns = T.StructType(
        [*keys.fields, T.StructField("run_ts", text), T.StructField("status", text)]
    )
    return _read(spark, path, columns, source, options or {})


HEADER = "report string, ord int, name string, kind string"


def headers_path(folder: str) -> str:
    """Where the runs below ``folder`` keep the headers of their reports."""
    return f"{folder.rstrip('/')}/headers"


def write_headers(spark: SparkSession, folder: str, run_id: str, headers: dict[str, list[str]]) -> None:
    """Keep what each report of a run shows, and as what: a score is a double, all else is text."""
    rows = [
        (report, n, field.name, field.dataType.simpleString())
        for report, names in headers.items() for n, field in enumerate(header_type(names).fields)
    ]
    table = spark.createDataFrame(rows, HEADER).coalesce(1)
    table.write.mode("errorifexists").parquet(f"{headers_path(folder)}/{RUN_ID}={run_id}")


def read_across_runs(
    spark: SparkSession,
    folder: str,
    report: str,
    keys: T.StructType = DOC_ID,
    source: str = "parquet",
    options: dict[str, str] | None = None,
) -> DataFrame:
    """A report (``qa_report`` or ``de_report``) of all runs that count, whatever questionnaire each had.

    Returns the ``keys``, ``run_ts`` and every column of any run, in the order in which the runs, by their times, bring
    them in; what a run did not ask is NULL. Runs with the same header are read at
    once, by the types that their header names, so that formats without types or
    names of columns can be told apart. A name that is a score in one run and a
    text in another is text. Headers, a few rows for each run, come to the driver.
    """
    runs = snapshot(spark, folder).runs
    kept = [T.StructField("run_ts", T.StringType())]
    headers: dict[str, list[tuple[str, str]]] = {run: [] for run in sorted(runs, key=lambda r: (runs[r], r))}
    if runs:
        written = spark.read.schema(f"{HEADER}, {RUN_ID} string").parquet(headers_path(folder))
        wanted = written.where((F.col("report") == report) & F.col(RUN_ID).isin(list(runs)))
        for row in sorted(wanted.collect(), key=lambda r: r["ord"]):
            headers[row[RUN_ID]].append((row["name"], row["kind"]))
    alike: dict[tuple, list[str]] = {}
    for run, header in headers.items():
        alike.setdefault(tuple(header), []).append(run)
    kinds: dict[str, str] = {}
    for header in alike:
        for name, kind in header:
            kinds[name] = kind if kinds.get(name, kind) == kind else "string"
    out = spark.createDataFrame([], T.StructType([*keys.fields, *kept]))
    for header, ids in alike.items():
        types = [T.StructField(name, T.DoubleType() if kind == "double" else T.StringType()) for name, kind in header]
        reader = spark.read.format(source).options(**(options or {}))
        base = f"{folder.rstrip('/')}/{report}"
        for_all = reader.schema(T.StructType([*keys.fields, *types, *kept])).option("basePath", base)
        rows = for_all.load([f"{base}/{RUN_ID}={run}" for run in ids])
        named = [F.col(f"`{name}`").cast(kinds[name]).alias(name) for name, _ in header]
        out = out.unionByName(rows.select(*keys.names, "run_ts", *named), allowMissingColumns=True)
    return out
