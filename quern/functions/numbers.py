"""How column texts are read as numbers and booleans, in one place for Spark and SQL.

A text is an integer or a float by an explicit pattern, never by whether a cast
succeeds: engines disagree on casts of 1_000, 1d, ' 1' and 1.5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
BOOLEANS = ("true", "false", "0", "1")


def is_integer(value: Column) -> Column:
    return value.rlike(INTEGER)


def is_float(value: Column) -> Column:
    return value.rlike(FLOAT)


def is_boolean(value: Column) -> Column:
    return F.lower(value).isin(*BOOLEANS)


def as_boolean(value: Column) -> Column:
    return F.lower(value).isin("true", "1")


def is_word(value: Column) -> Column:
    return F.lower(value).isin("true", "false")
