"""String helpers of the readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def head_and_rest(line: Column) -> tuple[Column, Column]:
    """Split at the first blank or tab; the newline goes, the rest is null if there is none."""
    parts = F.split(F.rtrim(F.regexp_replace(line, r"[\r\n]+$", "")), "[ \\t]+", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def right_trim(s: Column) -> Column:
    return F.regexp_replace(s, r"[ \t\r\n]+$", "")


def utterance_label(line: Column) -> Column:
    """What stands in the line's last parentheses; empty if there are none."""
    return F.regexp_extract(line, r"\(([^()]*)\)\s*$", 1)


def basename(path: Column) -> Column:
    """File name without folders and last extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def xml_safe(s: Column) -> Column:
    return F.translate(s, "<>", "[]")


def encode(rows: DataFrame, vocabulary: DataFrame, column: str = "word", keep_unknown: bool = True) -> DataFrame:
    """Adds ``word_id`` from a vocabulary (word, word_id); unknown, empty and null words get -1, or go."""
    out = rows.join(vocabulary.select(F.col("word").alias(column), "word_id"), column, "left" if keep_unknown else "inner")
    return out.withColumn("word_id", F.coalesce("word_id", F.lit(-1))) if keep_unknown else out


def decode(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Adds ``word`` by ``word_id``."""
    return rows.join(vocabulary.select("word_id", "word"), "word_id", "left")


def true_modulo(a: Column, n: int) -> Column:
    """Remainder that is never negative."""
    return F.pmod(a, F.lit(n))
