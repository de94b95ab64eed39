"""Reading a customer file of unknown layout.

Encoding, record shape and JSON shape are decided by distributed passes over the whole
input (every line is validated, counted or parsed on the executors); the driver
sees the header line and one-row summaries only. Paths may be files or folders of any
store that Spark reads.
"""

from __future__ import annotations

import csv
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config as C
from tidemark.functions.numeric import plain_text
from tidemark.session import ensure_checkpoint_dir, removed_at_end
from tidemark.sources.records import QuotedLines, list_elements, records

RAW = "__raw_record__"
SPARK_CHARSETS = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "latin1": "ISO-8859-1",
                  "latin-1": "ISO-8859-1", "cp1252": "windows-1252", "iso-8859-1": "ISO-8859-1",
                  "utf-16": "UTF-16", "ascii": "US-ASCII"}


def file_size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(f"File not found: {path}")
    return fs.getContentSummary(p).getLength()


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the input with their bytes untouched (column ``value``)."""
    return spark.read.option("lineSep", "\n").text(path)


def pick_encoding(lines: DataFrame, order: list[str]) -> str:
    """The first encoding that every line decodes in.

    The single-byte encodings accept any bytes, so the choice is between the
    UTF-8 names and the first single-byte one of the order.
    """
    good = lines.agg(F.min(F.is_valid_utf8("value"))).first()[0]
    utf8 = {"utf-8", "utf-8-sig"}
    return next((e for e in order if good is not False or e not in utf8), order[0])


def _first_line(lines: DataFrame, encoding: str) -> str:
    row = lines.filter(F.length(F.trim("value")) > 0).select(F.col("value").cast("binary").alias("b")).first()
    if row is None:
        return ""
    return bytes(row.b).decode(encoding, errors="replace").lstrip("\ufeff").rstrip("\r")


def _sniffed(header: str) -> str | None:
    try:
        return csv.Sniffer().sniff(header).delimiter
    except csv.Error:
        return None


def pick_delimiter_by_trial(header: str, n_lines: int = 2, order=C.CORE_SEPARATORS) -> str | None:
    """S3: the first separator that splits the header into two names or more, given a
    data row. The unnamed trial (None) is the comma first, then the sniffed one."""
    if n_lines < 2:
        return None
    for sep in order:
        for one in ((",", _sniffed(header)) if sep is None else (sep,)):
            if one and len(next(csv.reader([header], delimiter=one), [])) >= 2:
                return one
    return None


def pick_delimiter_by_count(text: str, limit: int = C.DELIMITER_SAMPLE_BYTES) -> str:
    """The candidate seen most often in the first 16 KB (ties: list order)."""
    sample = text[:limit]
    counts = {d: sample.count(d) for d in C.ADAPTIVE_DELIMITERS}
    best = max(counts, key=counts.get)
    return best if counts[best] > 0 else ","


def header_names(text: str, sep: str, lineage: str = "core") -> list[str]:
    """Names from the first line; empty names become ``Unnamed: i`` (core)
    or ``nan`` for a leading empty name after the adaptive header repair."""
    first = next(csv.reader([text.split("\n", 1)[0].rstrip("\r")], delimiter=sep), [])
    names = []
    for i, n in enumerate(first):
        n = n.lstrip("﻿")
        if lineage == "adaptive":
            n = n.strip()
        if n == "":
            n = "nan" if (lineage == "adaptive" and i == 0) else f"Unnamed: {i}"
        names.append(n)
    seen: dict[str, int] = {}
    out = []
    for n in names:  # duplicate names get pandas-style suffixes
        if n in seen:
            seen[n] += 1
            out.append(f"{n}.{seen[n]}")
        else:
            seen[n] = 0
            out.append(n)
    return out


def _field_count(raw: Column, sep: str) -> Column:
    """Fields of a raw record: separators outside quotes, plus one."""
    bare = F.regexp_replace(raw, r'"(?:[^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def _na_to_null(c: str) -> Column:
    return F.when(F.col(f"`{c}`").isin(C.NA_TEXTS), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c)


def spans_lines(lines: DataFrame) -> bool:
    """True when some line has an odd number of quotes, so that a quoted field may go on in the next."""
    odd = lines.agg(F.max(F.regexp_count("value", F.lit('"')) % 2)).first()[0]
    return odd == 1


def read_delimited(spark: SparkSession, path: str, sep: str, encoding: str,
                   names: list[str], skip_initial_space: bool = False,
                   multiline: bool = False) -> DataFrame:
    """Every cell as text; rows with too many fields are dropped, short
    rows are padded with nulls, the usual missing-value texts become null.

    Records of another length than the header keep their raw text, and
    their fields are counted there, so empty surplus fields count too.
    """
    cells = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cells] + [T.StructField(RAW, T.StringType())])
    charset = SPARK_CHARSETS.get(encoding, encoding)
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAW,
               "maxCharsPerColumn": "-1", "columnPruning": "false", "maxColumns": str(max(20480, 2 * len(names))),
               "ignoreLeadingWhiteSpace": str(skip_initial_space).lower(), "ignoreTrailingWhiteSpace": "false"}
    if multiline:
        # quoted line feeds: records are put together across lines and splits, then parsed one by one
        whole = records(spark, path, QuotedLines(sep, skip_initial_space), charset).filter(~F.col("head"))
        text = F.regexp_replace(F.regexp_replace("record", r"\r$", ""), "\r\n", "\n")
        df = whole.select(F.from_csv(text, schema.simpleString()[len("struct<"):-1].replace(":", " "), options).alias("r")).select("r.*")
    else:
        df = spark.read.schema(schema).options(header="true", encoding=charset, **options).csv(path)
    # naming every cell keeps the parser from being asked for the raw text alone
    long = (F.col(RAW).isNotNull() & (_field_count(F.col(RAW), sep) > len(names))
            & (F.length(F.concat_ws("", *cells)) >= 0))
    return df.where(~long).select(*[_na_to_null(c) for c in cells]).toDF(*names)


def load_csv_core(spark: SparkSession, path: str) -> DataFrame:
    """Core loader: encodings x separators in order, first usable wins."""
    lines = raw_lines(spark, path)
    enc = pick_encoding(lines, C.CORE_ENCODINGS)
    header = _first_line(lines, enc)
    sep = pick_delimiter_by_trial(header, lines.filter(F.length(F.trim("value")) > 0).count())
    if sep is None:
        raise RuntimeError("No known separator splits this file into a header and rows.")
    names = header_names(header, sep, "core")
    return read_delimited(spark, path, sep, enc, names, multiline=spans_lines(lines))


def load_csv_adaptive(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Adaptive loader: encoding order, delimiter by count, header repair."""
    lines = raw_lines(spark, path)
    enc = pick_encoding(lines, C.ADAPTIVE_ENCODINGS)
    header = _first_line(lines, enc)
    sep = delimiter or pick_delimiter_by_count(_start(lines, enc))
    names = header_names(header, sep, "adaptive")
    return read_delimited(spark, path, sep, enc, names, skip_initial_space=True, multiline=spans_lines(lines))


def _start(lines: DataFrame, encoding: str) -> str:
    """The text that the delimiter count looks at: a fixed number of bytes of the first lines."""
    n = C.DELIMITER_SAMPLE_BYTES
    rows = lines.select(F.substring(F.col("value").cast("binary"), 1, n).alias("b")).take(200)
    return b"\n".join(bytes(r.b) for r in rows if r.b is not None)[:n].decode(encoding, errors="ignore")


def json_shape(lines: DataFrame) -> str:
    """"lines", "records", "scalars" or "object".

    A document that starts with "[" is a list of what its first element is; one that starts with "{" is
    JSON Lines when there are several lines and each is an object of its own.
    """
    text = F.trim(F.regexp_replace(F.col("value"), "^\ufeff|[\r\t]", ""))
    solid = lines.select(text.alias("v")).filter(F.length("v") > 0)
    first = solid.select(F.substring("v", 1, 1).alias("c")).first()
    if first is None or first.c == "[":
        # the first element that is not white space after the bracket
        head = solid.select(F.regexp_extract("v", r"^\[?\s*(\S)", 1).alias("c")).filter("c not in ('', '[')").first()
        return "records" if head is None or head.c == "{" else "scalars"
    whole = F.col("v").startswith("{") & F.get_json_object("v", "$").isNotNull()
    r = solid.agg(F.count("*").alias("n"), F.min(whole).alias("all")).first()
    return "lines" if r.n > 1 and r.all else "object"


def text_lines(df: DataFrame) -> str:
    """``value`` written as text in the shared folder (removed at the end); the path."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    df.write.text(path)
    removed_at_end(spark, path)
    return path


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """Records array, JSON lines, dict of lists, single dict, scalar list."""
    shape = json_shape(raw_lines(spark, path))
    if shape == "lines":
        return spark.read.json(path)
    if shape in ("records", "scalars"):
        elements = list_elements(spark, path)
        if shape == "records":
            # one object a line from here on: line feeds inside an object stand outside its strings
            return spark.read.json(text_lines(elements.select(F.regexp_replace("value", "[\r\n]", " ").alias("value"))))
        element = F.concat(F.lit('{"v":'), F.col("value"), F.lit("}"))
        return elements.select(F.from_json(element, "v string")["v"].alias("value"))
    obj = spark.read.option("multiLine", "true").json(path)
    fields = obj.schema.fields
    if fields and all(isinstance(f.dataType, T.ArrayType) for f in fields):
        names = [f.name for f in fields]
        zipped = F.arrays_zip(*[F.col(f"`{n}`") for n in names])
        return obj.select(F.inline(zipped)).toDF(*names)
    return obj


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, floats in plain notation; nulls stay NULL."""
    df = spark.read.parquet(path)
    return df.select(*[plain_text(F.col(f"`{c}`"), t).alias(c) for c, t in df.dtypes])


def read_table(spark: SparkSession, path: str, lineage: str = "adaptive") -> DataFrame:
    """Dispatch by extension (unknown -> delimited text); missing, empty
    and tiny (< 10 bytes) files are refused."""
    size = file_size(spark, path)
    if size == 0:
        raise ValueError("File is empty (0 bytes)")
    if size < 10:
        raise ValueError("File too small to contain valid data")
    ext = os.path.splitext(urlparse(path).path)[1].lower()
    if ext in (".parquet", ".pq"):
        return load_parquet(spark, path)
    if ext == ".json":
        return load_json(spark, path)
    if ext in (".xlsx", ".xls", ".xlsm", ".xlsb", ".ods"):
        raise NotImplementedError("Workbook formats are not read; export the sheet as CSV or Parquet.")
    if lineage == "core":
        return load_csv_core(spark, path)
    if ext == ".tsv":
        return load_csv_adaptive(spark, path, delimiter="\t")
    return load_csv_adaptive(spark, path)
