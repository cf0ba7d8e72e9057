"""Delimited text: sniffing, null tokens, sampled types, projection, and the writing options.

Reading is Spark's CSV source, which splits files, prunes columns and parses in the JVM. Only a bounded sample (``SNIFF_LINES``
lines, ``SAMPLE_ROWS`` rows) ever comes to the driver. Files are split unless quotes hold line breaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from csv import reader as reader_of_lines
from typing import IO

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import ShapeMismatch, SourceError
from quillon.operators.frame import quoted
from quillon.operators.malformed import NULL_TOKENS
from quillon.types import dtype, num_to_text

SNIFF_LINES = 10
SAMPLE_ROWS = 100
# The separators that sniffing knows.
SEPARATORS = (",", ";", "\t", "|")
_INT = re.compile(r"[+-]?\d+")
_FLOAT = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z?)?")


def sniff_delimiter(lines: Sequence[str]) -> str:
    """The separator with the highest mean count outside quotes, doubled where every line has as many."""

    def outside(line: str) -> str:
        return re.sub(r'"(?:[^"]|"")*"?', "", line)

    best, best_score = ",", 0.0
    bare = [outside(line) for line in lines if line.strip()]
    for sep in SEPARATORS:
        counts = [line.count(sep) for line in bare]
        if counts and sum(counts):
            score = sum(counts) / len(counts) * (2 if len(set(counts)) == 1 else 1)
            if score > best_score:
                best, best_score = sep, score
    return best


def infer_text_type(values: Sequence[str | None], parse_numbers: bool = True, parse_dates: bool = True) -> T.DataType:
    """The narrowest of int, double, boolean, timestamp and text that holds a sample; only text for an all-null one."""
    present = [v.strip() for v in values if v is not None]
    if not present:
        return T.StringType()
    if parse_numbers and all(_FLOAT.fullmatch(v) for v in present):
        return T.IntegerType() if all(_INT.fullmatch(v) and abs(int(v)) < 2**31 for v in present) else T.DoubleType()
    if all(v.lower() in ("true", "false") for v in present):
        return T.BooleanType()
    if parse_dates and all(_DATE.fullmatch(v) for v in present):
        return T.TimestampNTZType()
    return T.StringType()


def parse_text(value: Column, kind: T.DataType) -> Column:
    """Text as a column's type; a value that is none becomes null, a fraction in an int column is cut off."""
    if isinstance(kind, T.StringType):
        return value
    text = F.trim(value)
    if isinstance(kind, T.BooleanType):
        return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        number = text.try_cast("double")
        whole = F.when(~F.isnan(number) & (F.abs(number) < 9e18), number)
        return F.coalesce(text.try_cast(kind), whole.try_cast(kind))
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return F.regexp_replace(text, "Z$", "").try_cast(kind)
    return text.try_cast(kind)


def spans_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> bool:
    """Whether some record may go on in the next line: such a record leaves a line with an odd number of double quotes.

    A pass over the lines in the JVM that ends at the first such line; without one every line is a record and files can be split.
    """
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    return bool(spark.read.option("encoding", encoding).text(path).where(F.col("value").contains('"') & odd).limit(1).count())


def _fetched(path: str, encoding: str) -> str:
    from urllib.request import urlopen

    try:
        with urlopen(path) as answer:
            return answer.read().decode(encoding)
    except OSError as error:
        raise SourceError(f"cannot read {path!r}: {error}") from error


def read_csv(
    spark: SparkSession,
    path: str | None = None,
    *,
    text: str | IO | None = None,
    delimiter: str | None = None,
    encoding: str = "UTF-8",
    has_header: bool = True,
    header: Sequence[str] | None = None,
    dtypes: Mapping[str, str] | None = None,
    parse_numbers: bool = True,
    parse_dates: bool = True,
    n_rows: int | None = None,
    skip_rows: int = 0,
    columns: Sequence[str] | None = None,
    null_values: Sequence[str] = NULL_TOKENS,
    comment: str | None = None,
    multiline: bool | None = None,
    on_bad: str = "null",
) -> DataFrame:
    """A CSV file, folder, ``http(s)`` address or ``text`` (or something to read it from); RFC 4180 quoting.

    Short rows are padded with null, surplus fields dropped, blank lines skipped. ``header`` overrides the names, and with
    ``has_header`` each file's own header line is still skipped. ``columns`` keeps the file's order and ignores unknown names.
    ``skip_rows`` lines of each file are skipped before its header; lines that start with ``comment``, indented or not, are none.
    ``multiline`` says whether quotes may hold line breaks, which keeps files from being split; by default a pass over the lines
    finds out (:func:`spans_lines`). Types come from a sample; a later value that does not fit is null, with ``on_bad='raise'`` an
    error, and with ``on_bad='column'`` its column is named in ``_misfits``, an array.
    """
    if (path is None) == (text is None):
        raise SourceError("pass either a path or text")
    if on_bad not in ("null", "raise", "column"):
        raise SourceError("on_bad is 'null', 'raise' or 'column'")
    if path is not None and re.match("https?://", path):
        path, text = None, _fetched(path, encoding)
    if text is not None and not isinstance(text, str):
        content = text.read()
        text = content.decode(encoding) if isinstance(content, bytes) else content
    many = False
    if text is None:
        many = spans_lines(spark, path, encoding) if multiline is None else multiline
    options = {"encoding": encoding, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "emptyValue": "", "nullValue": "\u0000", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "inferSchema": "false"}
    if text is None and not skip_rows and not comment:
        sample = [r[0] for r in spark.read.option("encoding", encoding).text(path).limit(SNIFF_LINES).collect()]
        if not any(line.strip() for line in sample):
            raise SourceError("no data to read")
        reader = spark.read.options(sep=delimiter or sniff_delimiter(sample), header=str(has_header).lower(), multiLine=str(many).lower(), **options)
        found = reader.csv(path).columns
        names = _names(header, [n.strip().lstrip("\ufeff") for n in found] if has_header else None, len(found))
        rows = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    else:
        if text is not None:
            records, sample = _records_after(spark, text, skip_rows, comment)
        elif many:
            records, sample = _whole_files(spark, path, encoding, skip_rows, comment)
        else:
            records, sample = _lines_after(spark, path, encoding, skip_rows, comment)
        if not sample:
            raise SourceError("no data to read")
        sep = delimiter or sniff_delimiter(sample)
        first = next(reader_of_lines(sample[:1], delimiter=sep))
        names = _names(header, [n.strip() for n in first] if has_header else None, len(first))
        body = records.where("NOT first") if has_header else records
        made = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(len(names)))), {**options, "sep": sep})
        rows = body.select(made.alias("r")).select(*[F.col("r")[f"c{i}"].alias(n) for i, n in enumerate(names)])
    rows = rows.where(~F.concat_ws("", *[quoted(n) for n in names]).rlike(r"\A\s*\z") | F.greatest(*[quoted(n) for n in names], F.lit("")).contains(" "))
    cleaned = rows.select(*[F.when(~quoted(n).isin(*null_values), quoted(n)).alias(n) for n in names])
    chosen = [n for n in names if columns is None or n in columns]
    cleaned = cleaned.select(*[quoted(n) for n in chosen])
    declared = {n: dtype(k) for n, k in (dtypes or {}).items()}
    open_names = [n for n in chosen if n not in declared]
    kinds = dict(declared)
    if open_names:
        head = cleaned.select(*[quoted(n) for n in open_names]).limit(SAMPLE_ROWS).collect()
        kinds |= {n: infer_text_type([r[i] for r in head], parse_numbers, parse_dates) for i, n in enumerate(open_names)}
    parsed = {n: parse_text(quoted(n), kinds[n]) for n in chosen}
    misfit = {n: quoted(n).isNotNull() & parsed[n].isNull() for n in chosen if not isinstance(kinds[n], T.StringType)}
    if on_bad == "raise":
        parsed |= {n: F.when(~bad, parsed[n]).when(bad, F.raise_error(F.concat(F.lit(f"{n}: no {kinds[n].simpleString()}: "), quoted(n))).cast(kinds[n])) for n, bad in misfit.items()}
    extra = [F.filter(F.array(*[F.when(bad, n) for n, bad in misfit.items()]).cast("array<string>"), lambda x: x.isNotNull()).alias("_misfits")] if on_bad == "column" else []
    out = cleaned.select(*[parsed[n].alias(n) for n in chosen], *extra)
    return out.limit(n_rows) if n_rows is not None else out


def _names(header: Sequence[str] | None, found: list[str] | None, width: int) -> list[str]:
    names = list(header) if header else found if found is not None else [f"column_{i}" for i in range(width)]
    if len(names) != width:
        raise ShapeMismatch(f"{len(names)} names for {width} columns")
    return names


def _usable(line: str, comment: str | None) -> bool:
    return bool(line.strip()) and not (comment and line.lstrip().startswith(comment))


def _records_after(spark: SparkSession, text: str, skip_rows: int, comment: str | None) -> tuple[DataFrame, list[str]]:
    """(value, first) per record of a text, and the first records."""
    records = [r for r in _records("\n".join(re.split(r"\r?\n", text.lstrip("\ufeff"))[skip_rows:]), comment)]
    return spark.createDataFrame([(r, i == 0) for i, r in enumerate(records)], "value string, first boolean"), records[:SNIFF_LINES]


def _whole_files(spark: SparkSession, path: str, encoding: str, skip_rows: int, comment: str | None) -> tuple[DataFrame, list[str]]:
    """Files whose records span lines and whose lines count: a file is a task, as with any reader of such files."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                lines = re.split(r"\r?\n", content.decode(encoding).lstrip("\ufeff"))[skip_rows:]
                records = list(_records("\n".join(lines), comment))
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.string()), pa.array([i == 0 for i in range(len(records))], pa.bool_())], names=["value", "first"])

    records = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string, first boolean")
    firsts = records.where("first").limit(1).collect()
    rest = records.where("NOT first").limit(SNIFF_LINES - 1).collect() if firsts else []
    return records, [r["value"] for r in [*firsts, *rest]]


def _lines_after(spark: SparkSession, path: str, encoding: str, skip_rows: int, comment: str | None) -> tuple[DataFrame, list[str]]:
    """The usable lines of files where each line is a record, with ``first`` for the first of each file after the skipped ones.

    A line's place is the scan's own order, which grows along each file. What is found per file is a row per file.
    """
    lines = spark.read.option("encoding", encoding).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__at"))
    place = F.row_number().over(Window.partitionBy("__file").orderBy("__at"))
    skipped = lines.withColumn("__place", place).where(F.col("__place") <= skip_rows).groupBy("__file").agg(F.max("__at").alias("__skip"))
    kept = lines.join(skipped, "__file", "left").where(F.col("__skip").isNull() | (F.col("__at") > F.col("__skip"))) if skip_rows else lines
    kept = kept.where(F.trim(F.col("value")) != "")
    kept = kept.where(~F.ltrim(F.col("value")).startswith(comment)) if comment else kept
    firsts = kept.groupBy("__file").agg(F.min("__at").alias("__first"))
    marked = kept.join(firsts, "__file").select(F.regexp_replace("value", "^\ufeff", "").alias("value"), (F.col("__at") == F.col("__first")).alias("first"))
    head = marked.where("first").limit(1).collect()
    rest = marked.where("NOT first").limit(SNIFF_LINES - 1).collect() if head else []
    return marked, [r["value"] for r in [*head, *rest]]


def _records(text: str, comment: str | None = None) -> list[str]:
    """The usable records of a text: its lines, joined where a line break stands inside quotes."""
    out, held = [], ""
    for line in re.split(r"\r?\n", text):
        if not held and not _usable(line, comment):
            continue
        held = f"{held}\n{line}" if held else line
        if held.count('"') % 2 == 0:
            out.append(held)
            held = ""
    return out + ([held] if held.strip() else [])


def csv_value(value: Column, kind: T.DataType) -> Column:
    """A value as CSV text: whole numbers without a fraction, times in ISO form, nested values as JSON."""
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return num_to_text(value, kind)


def csv_lines(df: DataFrame, delimiter: str = ",", quote_style: str = "necessary", null_value: str = "") -> DataFrame:
    """One text column ``value`` with a row per record, quoted 'always', when 'necessary', or 'never'."""
    risky = "[" + re.sub(r"([\[\]\\^])", r"\\\1", delimiter) + '"\\r\\n]'
    parts = []
    for f in df.schema.fields:
        text = csv_value(quoted(f.name), f.dataType)
        wrapped = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        shown = text if quote_style == "never" else wrapped if quote_style == "always" else F.when(text.rlike(risky), wrapped).otherwise(text)
        parts.append(F.coalesce(shown, F.lit(null_value)))
    return df.select(F.concat_ws(delimiter, *parts).alias("value"))


def header_line(columns: Sequence[str], delimiter: str, quote_style: str) -> str:
    def shown(name: str) -> str:
        needs = quote_style == "always" or (quote_style == "necessary" and re.search(f'[{re.escape(delimiter)}"\r\n]', name))
        return '"' + name.replace('"', '""') + '"' if needs else name

    return delimiter.join(shown(c) for c in columns)


def to_csv_text(df: DataFrame, *, delimiter: str = ",", quote_style: str = "necessary", null_value: str = "", header: bool = True, bom: bool = False) -> str:
    """A driver-sized frame as CSV text, streamed partition by partition."""
    lines = [header_line(df.columns, delimiter, quote_style)] if header else []
    lines += [r[0] for r in csv_lines(df, delimiter, quote_style, null_value).toLocalIterator()]
    body = "".join(line + "\n" for line in lines)
    return ("﻿\n" if bom else "") + body


def write_csv(df: DataFrame, path: str, *, delimiter: str = ",", quote_style: str = "necessary", null_value: str = "", header: bool = True, mode: str = "overwrite") -> None:
    """A folder of CSV files, one per partition, each with a header."""
    shaped = df.select(*[csv_value(quoted(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
    if quote_style == "never":
        csv_lines(df, delimiter, "never", null_value).write.mode(mode).text(path)
        return
    options = {"sep": delimiter, "header": str(header).lower(), "nullValue": null_value, "quote": '"', "escape": '"', "emptyValue": "", "quoteAll": str(quote_style == "always").lower(), "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    shaped.write.mode(mode).options(**options).csv(path)
