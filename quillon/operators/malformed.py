"""Separating delimited records that fail to parse from the valid ones, with the reason and the first broken field.

Method: from a record schema one anchored regular expression for a whole valid row is generated (quoting, number of fields and
the lexical form of every typed value, 32-bit range included). Rows that match are loaded from its capture groups. Rows that do
not match pass through incremental field-prefix patterns (the first one, two, ... fields), whose first failure names the broken
field, and through the two untyped patterns that tell bad quoting and wrong column counts from bad values.

All patterns use possessive quantifiers: the regex engine never backtracks into a field and needs no stack that grows with the
text, so very long records cost linear time. Everything is built-in JVM expressions in one projection; no row is shuffled.

Defined results for edge cases: null and blank records (only white space) have status ``blank`` and neither load nor fail; one
LF or CRLF at the end is not part of the record; null tokens, quoted or not, load as null in every column; repeated records are
kept, each under its own id; a table without rows gives tables without rows; input columns other than the raw text are carried
along, and one that clashes with a field's name keeps its name while the field gets the suffix ``_parsed``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.errors import InvalidOperation

# The texts that stand for null in delimited files.
NULL_TOKENS = ("", "null", "NULL", "NA", "N/A", "NaN", "nan", "None", "none")
KINDS = {"string": "string", "int": "int", "long": "bigint", "boolean": "boolean", "double": "double"}


@dataclass(frozen=True)
class RecordSchema:
    """``fields``: (name, kind) pairs in file order; ``sep``: one character other than the double quote."""

    fields: tuple[tuple[str, str], ...]
    sep: str = ","
    null_tokens: tuple[str, ...] = NULL_TOKENS

    def __post_init__(self) -> None:
        if len(self.sep) != 1 or self.sep == '"':
            raise InvalidOperation("a separator is one character and no double quote")
        if not self.fields or any(kind not in KINDS for _, kind in self.fields):
            raise InvalidOperation(f"fields need one of the kinds {sorted(KINDS)}")


def _java_quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def digits_up_to(limit: int) -> str:
    """A pattern for the decimal numbers 1..limit without leading zeros."""
    text = str(limit)
    parts = [f"[1-9][0-9]{{0,{len(text) - 2}}}"] if len(text) > 1 else []
    for i, digit in enumerate(text):
        low = 1 if i == 0 else 0
        if int(digit) > low:
            upper = int(digit) - 1
            span = f"[{low}-{upper}]" if upper > low else str(low)
            parts.append(f"{text[:i]}{span}[0-9]{{{len(text) - i - 1}}}")
    parts.append(text)
    return "(?:" + "|".join(parts) + ")"


def _integer(bits: int) -> str:
    least, most = 2 ** (bits - 1), 2 ** (bits - 1) - 1
    return f"(?:-(?=[0-9])0*+{digits_up_to(least)}?|\\+?(?=[0-9])0*+{digits_up_to(most)}?)"


class Patterns:
    """The generated patterns of one schema, in the JVM's regex dialect."""

    def __init__(self, schema: RecordSchema) -> None:
        d = _java_quote(schema.sep)
        self.quoted = r'"[^"]*+(?:""[^"]*+)*+"'
        self.any_field = f'(?:{self.quoted}|[^"{d}]*+)'
        tokens = "|".join(_java_quote(t) for t in sorted(schema.null_tokens, key=len, reverse=True))
        inner = {
            "int": f" *+{_integer(32)} *+|(?:{tokens})",
            "long": f" *+{_integer(64)} *+|(?:{tokens})",
            "boolean": f"(?i:true|false)|(?:{tokens})",
            "double": rf" *+[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)? *+|(?:{tokens})",
        }

        def typed(kind: str) -> str:
            return self.any_field if kind == "string" else f'(?:"(?:{inner[kind]})"|(?:{inner[kind]}))(?={d}|\\z)'

        kinds = [kind for _, kind in schema.fields]
        n = len(kinds)
        self.quoting = f"\\A{self.any_field}(?:{d}{self.any_field})*+\\z"
        self.columns = f"\\A{self.any_field}(?:{d}{self.any_field}){{{n - 1}}}\\z"
        self.whole = "\\A" + d.join(f"({typed(k)})" for k in kinds) + "\\z"
        end = f"(?={d}|\\z)"
        self.field_prefix = [f"\\A{self.any_field}(?:{d}{self.any_field}){{{i}}}{end}" for i in range(n)]
        self.value_prefix = ["\\A" + d.join(typed(k) for k in kinds[: i + 1]) + end for i in range(n)]


def _first_failing(line: Column, patterns: list[str], names: list[str], beyond: str) -> Column:
    found = F.lit(beyond)
    for pattern, name in reversed(list(zip(patterns, names))):
        found = F.when(~line.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def classify(df: DataFrame, schema: RecordSchema, raw: str = "raw_line") -> DataFrame:
    """Every input row with ``status`` ('valid', 'failed', 'blank'), ``reason`` and ``broken_field`` (both null unless failed),
    and ``__line``, the record without its line end.

    ``reason`` is the first that applies of 'quoting', 'columns', 'value'. ``broken_field`` is the first field at which the
    incremental prefix pattern fails; '(beyond)' stands for surplus fields.
    """
    p, names = Patterns(schema), [name for name, _ in schema.fields]
    line = F.regexp_replace(F.col(raw), r"\r?\n\z", "")
    bare = df.withColumn("__line", line)
    line = F.col("__line")
    status = F.when(line.isNull() | line.rlike(r"\A\s*+\z"), "blank").when(line.rlike(p.whole), "valid").otherwise("failed")
    failed = F.col("status") == "failed"
    reason = F.when(failed, F.when(~line.rlike(p.quoting), "quoting").when(~line.rlike(p.columns), "columns").otherwise("value"))
    broken = F.when(F.col("reason") == "value", _first_failing(line, p.value_prefix, names, "(beyond)")).when(
        F.col("reason").isNotNull(), _first_failing(line, p.field_prefix, names, "(beyond)")
    )
    return bare.withColumn("status", status).withColumn("reason", reason).withColumn("broken_field", broken)


def _field(line: Column, whole: str, i: int, kind: str, schema: RecordSchema) -> Column:
    text = F.regexp_extract(line, whole, i + 1)
    text = F.when(text.startswith('"'), F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit('""'), F.lit('"'))).otherwise(text)
    value = F.when(~text.isin(*schema.null_tokens), text)
    return value if kind == "string" else F.trim(value).try_cast(KINDS[kind])


def valid_rows(classified: DataFrame, schema: RecordSchema, raw: str = "raw_line") -> DataFrame:
    """The typed rows of a :func:`classify` result: the carried columns, then the schema's fields."""
    carried = [c for c in classified.columns if c not in (raw, "__line", "status", "reason", "broken_field")]
    whole = Patterns(schema).whole
    fields = [_field(F.col("__line"), whole, i, kind, schema).alias(name + "_parsed" * (name in carried)) for i, (name, kind) in enumerate(schema.fields)]
    return classified.where(F.col("status") == "valid").select(*carried, *fields)


def failed_rows(classified: DataFrame) -> DataFrame:
    """The rejected rows of a :func:`classify` result with their raw text, reason and first broken field."""
    return classified.where(F.col("status") == "failed").drop("__line", "status")
