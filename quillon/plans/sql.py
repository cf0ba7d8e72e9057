"""SQL over one frame called ``this``: a validator for the accepted statement, everything else is Spark's own parser and planner."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame

from quillon.errors import ColumnNotFound, ParseError

_STRING = r"'(?:[^']|'')*'"
_TOKEN = re.compile(rf"{_STRING}|[A-Za-z_]\w*|`[^`]*`|\"[^\"]*\"|\d+(?:\.\d+)?|<>|!=|>=|<=|\S")
AGGREGATES = ("SUM", "AVG", "COUNT", "MIN", "MAX")
_FORBIDDEN = ("JOIN", "UNION", "INTERSECT", "EXCEPT", "WITH", "INSERT", "CREATE", "DROP", "ALTER")


def _tokens(sql: str) -> list[tuple[str, int]]:
    return [(m.group(), m.start()) for m in _TOKEN.finditer(sql)]


def _validate(sql: str) -> None:
    """SELECT ... FROM this ... as the one accepted statement; names the position of what is wrong."""
    tokens = _tokens(sql)
    if not tokens:
        raise ParseError("empty statement", position=0)
    if tokens[0][0].upper() != "SELECT":
        raise ParseError(f"expected SELECT at {tokens[0][1]}", position=tokens[0][1])
    froms = [i for i, (t, _) in enumerate(tokens) if t.upper() == "FROM"]
    if not froms:
        raise ParseError("expected FROM", position=len(sql))
    for token, at in tokens:
        if token.upper() in _FORBIDDEN:
            raise ParseError(f"{token.upper()} is not supported at {at}", position=at)
    if len(froms) > 1:
        raise ParseError(f"one FROM only, another at {tokens[froms[1]][1]}", position=tokens[froms[1]][1])
    after = froms[0] + 1
    if after >= len(tokens) or tokens[after][0].lower() != "this":
        at = tokens[after][1] if after < len(tokens) else len(sql)
        raise ParseError(f"the table is called 'this', at {at}", position=at)


def _with_aliases(sql: str) -> str:
    """Unaliased aggregates in the select list get the names ``sum_x``, ``count``."""
    start, stop = re.match(r"\s*SELECT\b", sql, re.I).end(), re.search(rf"(?:{_STRING}|[^'])*?\bFROM\b", sql, re.I).end() - 4
    items, depth, held = [], 0, ""
    for token in re.findall(rf"{_STRING}|.", sql[start:stop], re.S):
        depth += (token == "(") - (token == ")")
        if token == "," and depth == 0:
            items.append(held)
            held = ""
        else:
            held += token
    items.append(held)

    def named(item: str) -> str:
        m = re.fullmatch(rf"\s*({'|'.join(AGGREGATES)})\s*\(\s*(\*|[A-Za-z_]\w*)\s*\)\s*", item, re.I)
        if not m:
            return item
        name = "count" if m[2] == "*" else f"{m[1].lower()}_{m[2]}"
        return f" {m[1]}({m[2]}) AS {name} "

    return sql[:start] + ",".join(named(x) for x in items) + sql[stop:]


def query(df: DataFrame, sql: str) -> DataFrame:
    """Runs ``SELECT ... FROM this [WHERE] [GROUP BY] [HAVING] [ORDER BY] [LIMIT]`` over the frame.

    Unaliased aggregates are called ``sum_x``, ``avg_x``, ..., ``count``; an ORDER BY without a word on nulls puts them last.
    """
    _validate(sql)
    view = f"this_{uuid.uuid4().hex}"
    text = _nulls_last(_with_aliases(sql.strip().rstrip(";")))
    text = re.sub(r"(\bFROM\s+)this\b", rf"\g<1>{view} AS this", text, count=1, flags=re.I)
    df.createOrReplaceTempView(view)
    try:
        return df.sparkSession.sql(text)
    except ParseException as error:
        raise ParseError(str(error).split("\n")[0]) from error
    except AnalysisException as error:
        missing = re.search(r"name `([^`]+)`", str(error))
        if "UNRESOLVED_COLUMN" in str(error) and missing:
            raise ColumnNotFound(missing[1], df.columns) from error
        raise
    finally:
        df.sparkSession.catalog.dropTempView(view)


def _nulls_last(sql: str) -> str:
    m = re.search(r"\bORDER\s+BY\b(.*?)(\bLIMIT\b.*)?$", sql, re.I | re.S)
    if not m or re.search(r"\bNULLS\b", m[1], re.I):
        return sql
    items, depth, held = [], 0, ""
    for ch in m[1]:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            items.append(held)
            held = ""
        else:
            held += ch
    items.append(held)
    return sql[: m.start(1)] + ",".join(f"{x.rstrip()} NULLS LAST" for x in items) + " " + (m[2] or "")
