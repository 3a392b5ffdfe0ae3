"""Substring search with an index: three characters at a time lead to the rows that can match, which are then looked at."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import KeyedTable, persisted

#: Characters of a gram, and grams that are sorted and handed on at once.
N, HELD = 3, 1 << 18


def literal_runs(pattern: str) -> list[str]:
    """What a pattern has between its wildcards ``%`` and ``_``; a backslash takes a wildcard's meaning."""
    out, run, chars = [], "", iter(pattern)
    for c in chars:
        if c in "%_":
            out, run = [*out, run], ""
        else:
            run += next(chars, "") if c == "\\" else c
    return [r for r in [*out, run] if r]


def _codes(text: str) -> np.ndarray:
    """A number for each gram of a text, in which it stands."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (points[:-2] << 42) | (points[1:-1] << 21) | points[2:] if len(points) >= N else np.empty(0, np.int64)


def grams_of_batches(batches: Iterator[pa.RecordBatch], name: str, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """``gram, <name>``, each gram once for each row, of many rows at once: grams are numbers, and each distinct one becomes a text once."""
    for batch in batches:
        first, found, held = 0, [], 0
        for i in range(batch.num_rows):
            found.append(np.unique(np.concatenate([_codes(batch.column(c)[i].as_py()) for c in columns])))
            held += len(found[-1])
            if held >= HELD or held and i == batch.num_rows - 1:
                codes = np.concatenate(found)
                rows = np.repeat(np.arange(first, i + 1), [len(x) for x in found])
                order = np.argsort(codes, kind="stable")
                codes, rows = codes[order], rows[order]
                starts = np.flatnonzero(np.diff(codes, prepend=-1))
                texts = ["".join(map(chr, (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF))) for c in codes[starts].tolist()]
                place = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(codes)))
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()).take(pa.array(place)), batch.column(name).take(pa.array(rows))], ["gram", name])
                first, found, held = i + 1, [], 0


def grams_of(text: str) -> set[str]:
    return {text[i : i + N] for i in range(len(text) - N + 1)}


class SubstringIndex:
    """Rows ``(id, columns)`` below ``path`` that are found by what they contain, whatever the case.

    ``grams`` has a row for each three characters that a row's columns hold in lower case, ``texts`` the rows
    themselves; both change with the rows that a batch names. A search reads the grams of its pattern's literal runs, then
    the texts of those rows only that have them all. A pattern without three characters in a row leaves no other way than
    to look at all texts.
    """

    def __init__(self, spark: SparkSession, path: str, columns: tuple[str, ...], id_col: str = "note_id") -> None:
        self.spark, self.columns, self.id_col = spark, columns, id_col
        self.grams, self.texts = KeyedTable(spark, f"{path.rstrip('/')}/grams", [id_col], order=["gram", id_col]), KeyedTable(spark, f"{path.rstrip('/')}/texts", [id_col])

    def _cut(self, rows: DataFrame) -> DataFrame:
        """``gram, <id>``, once for each row."""
        low = rows.select(self.id_col, *[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in self.columns])
        columns, name = self.columns, self.id_col
        schema = T.StructType([T.StructField("gram", T.StringType()), rows.schema[name]])
        return low.mapInArrow(lambda batches: grams_of_batches(batches, name, columns), schema)

    def apply(self, changed: DataFrame, number: int, gone: DataFrame | None = None, stream: str = "rows") -> int:
        """Rows in place of those with their ids, and ids that went, whether or not they are among the rows; the bytes written. Ids are not repeated within a batch."""
        new = changed.select(self.id_col, *self.columns)
        new = persisted(new if gone is None else new.join(gone, self.id_col, "left_anti"), "changed")
        ids = new.select(self.id_col) if gone is None else new.select(self.id_col).unionByName(gone.select(self.id_col))
        ids = persisted(ids.distinct(), "ids")
        # a row's grams go with its id, so what it held before need not be known
        return self.grams.upsert(persisted(self._cut(new), "grams"), number, ids, stream) + self.texts.upsert(new, number, ids, stream)

    def candidates(self, runs: list[str]) -> DataFrame | None:
        """``id`` of the rows that have all grams of the runs; None if these are too short to have any."""
        wanted = sorted(set().union(*(grams_of(r) for r in runs), set()))
        if not wanted:
            return None
        asked = self.spark.createDataFrame([(g,) for g in wanted], "gram string")
        found = self.grams.lookup(asked)
        # a row has each gram once
        return found.groupBy(self.id_col).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select(self.id_col)

    def _passing(self, runs: list[str], test: Column) -> DataFrame:
        if not self.texts.state().segments:
            raise LookupError("the index was not built")
        low = [r[0] for r in self.spark.createDataFrame([(r,) for r in runs], "r string").select(F.lower("r")).collect()]
        ids = self.candidates(low)
        rows = self.texts.read() if ids is None else self.texts.lookup(persisted(ids, "candidates"))
        return rows.where(test)

    def search(self, pattern: str) -> DataFrame:
        """Rows of which a column matches a pattern with ``%`` and ``_``, as ``ilike`` has it."""
        return self._passing(literal_runs(pattern), reduce(Column.__or__, [F.col(c).ilike(pattern) for c in self.columns]))

    def containing(self, needle: str, exact: bool = False) -> DataFrame:
        """Rows of which a column holds a text, in any case or exactly so."""
        low = F.lower(F.lit(needle))
        test = reduce(Column.__or__, [F.contains(F.col(c), F.lit(needle)) if exact else F.contains(F.lower(c), low) for c in self.columns])
        return self._passing([needle], test)
