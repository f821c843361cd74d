"""Table functions for SQL: a row with a sequence or a text becomes a row for each window or sentence.

    SELECT * FROM token_windows(TABLE(docs) PARTITION BY (doc_id) ORDER BY (paragraph), 'ids', 512, 64)
    SELECT d.doc_id, s.* FROM docs AS d, LATERAL sentences(d.text) AS s

``token_windows`` takes any table: all columns come back, the named one cut into windows, behind a number ``window`` that
goes on over the rows of a partition in their order. Of a partition nothing but that number is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf


class TokenWindows:
    """Windows of at most ``max_length`` less ``specials`` tokens that overlap by ``stride``; the last one reaches the end. Null
    and empty sequences have none."""

    def __init__(self) -> None:
        self.number = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, max_length: AnalyzeArgument, stride: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or any(not x.isConstantExpression for x in (column, max_length, stride)):
            raise ValueError("token_windows needs a table, and a column's name, a length and a stride that are constant")
        if column.value not in rows.dataType.fieldNames() or not isinstance(rows.dataType[column.value].dataType, T.ArrayType):
            raise ValueError(f"no column of sequences: {column.value}")
        if max_length.value < 3 or not 0 <= stride.value < max_length.value - 2:
            raise ValueError("a window needs room for content and must advance")
        others = [f for f in rows.dataType.fields if f.name != column.value]
        return AnalyzeResult(schema=T.StructType([*others, T.StructField("window", T.IntegerType()), rows.dataType[column.value]]))

    def eval(self, row: T.Row, column: str, max_length: int, stride: int) -> Iterator[tuple]:
        own = row.asDict()
        tokens = own.pop(column) or []
        capacity = max_length - 2
        for at in range(0, max(len(tokens) - stride - 1, 0) + 1 if tokens else 0, capacity - stride):
            yield (*own.values(), self.number, tokens[at : at + capacity])
            self.number += 1


class Sentences:
    """Sentences of a text, numbered from 0, by the rules of ``sentences_by_line``."""

    #: White space of any script, as the rules trim it.
    WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
    #: The end of a sentence within a line.
    CUT = re.compile(r"""(?<=[.!?])\s+(?=[A-Z0-9"“'])""", re.ASCII)

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        lines = re.split(r"\n+", re.sub(r"[\t\r ]+", " ", text or ""))
        kept = (s.strip(self.WHITE) for line in lines for s in self.CUT.split(line))
        yield from enumerate(s for s in kept if s)


def register(spark: SparkSession) -> None:
    """Makes both functions known to a session's SQL."""
    spark.udtf.register("token_windows", udtf(TokenWindows))
    spark.udtf.register("sentences", udtf(Sentences, returnType="sentence int, text string"))
