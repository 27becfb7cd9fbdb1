"""Reversible columnar encodings: inference, encoders and their inverses.

A column is a table (ordinal, value) of texts; an empty text or null is null.
Inference looks at the whole column. All columns of a table are profiled in one
aggregation, and only those whose values are all integers are looked at again
for order. Encoders work on the non-null values in the order of `ordinal`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import numbers
from quern.operators.ordered import PART, TotalOrder

#: Integers of more digits are kept as texts: their differences would not fit a decimal(38,0).
MAX_DIGITS = 37
#: Positions of a run that one row unfolds.
PIECE = 65_536

ENCODINGS = ("delta", "delta-of-delta", "bit-pack", "dictionary", "rle", "ieee-754", "plain")


def non_null(value: str | Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value != "", value)


def digits(value: Column) -> Column:
    """How many digits an integer's text has, without sign and leading zeros."""
    return F.length(F.regexp_replace(value, "^[+-]?0*", ""))


# --- inference ---------------------------------------------------------------


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: rows, present, distinct, and whether all values are booleans, integers or floats."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), non_null(F.col(c).cast("string")).alias("value")) for i, c in enumerate(columns)])).alias("x")).select("x.*")
    # values are counted first, so a frequent value is one row in the second aggregation
    values = long.groupBy("position", "name", "value").agg(F.count(F.lit(1)).alias("times"))
    v = F.col("value")
    seen = v.isNotNull()
    return values.groupBy("position", "name").agg(
        F.sum("times").alias("rows"),
        F.coalesce(F.sum(F.when(seen, F.col("times"))), F.lit(0)).cast("long").alias("present"),
        F.count("value").alias("distinct"),
        F.coalesce(F.bool_and(F.when(seen, numbers.is_boolean(v))), F.lit(False)).alias("boolean"),
        F.coalesce(F.bool_and(F.when(seen, numbers.is_integer(v))), F.lit(False)).alias("integer"),
        F.coalesce(F.bool_and(F.when(seen, numbers.is_float(v))), F.lit(False)).alias("float"),
    )


def decide(profiles: DataFrame, time_field: str | None = None) -> DataFrame:
    """Adds type and encoding; an integer column's encoding is null until its order is known."""
    n, unique = F.col("present"), F.col("distinct")
    is_time = F.lit(False) if time_field is None else F.col("name") == time_field
    integral = F.col("integer") | (n == 0)
    kind = (
        F.when(is_time & integral, "timestamp").when(is_time, "timestamp-text")
        .when(F.col("boolean"), "boolean").when(F.col("integer"), "integer").when(F.col("float"), "float").otherwise("string")
    )
    quarter, three = F.floor(n / 4), F.floor(n * 3 / 4)
    text = F.when((n > 0) & (unique <= F.greatest(F.lit(16), quarter)), "dictionary").when((n > 2) & (unique < three), "rle").otherwise("plain")
    encoding = F.create_map(*[F.lit(x) for x in ("timestamp", "delta", "timestamp-text", "dictionary", "boolean", "bit-pack", "float", "ieee-754")])
    typed = profiles.withColumn("type", kind)
    return typed.withColumn("encoding", F.when(F.col("type") == "string", text).when(F.col("type") == "integer", F.lit(None)).otherwise(F.try_element_at(encoding, F.col("type"))))


def infer(df: DataFrame, ordinal: str, columns: list[str], time_field: str | None = None) -> DataFrame:
    """(position, name, type, encoding, rows, present, distinct) of all columns."""
    decided = decide(profile(df, columns), time_field)
    rows = decided.collect()  # a row per column
    delta = [r["name"] for r in rows if r["encoding"] is None]
    order = monotonic_columns(df, ordinal, delta) if delta else {}
    rising = F.create_map(*[x for name, ok in order.items() for x in (F.lit(name), F.lit(ok))]) if order else None
    encoding = F.col("encoding") if rising is None else F.coalesce("encoding", F.when(F.try_element_at(rising, F.col("name")), "delta").otherwise("plain"))
    return decided.select("position", "name", "type", encoding.alias("encoding"), "rows", "present", "distinct")


def monotonic_columns(df: DataFrame, ordinal: str, names: list[str]) -> dict[str, bool]:
    """Whether the non-null integers of each column never fall; true for an empty one, false where one has over MAX_DIGITS digits.

    One range sort for all columns: a column rises if it does so within every
    range, and no range's smallest value lies below the largest of those before.
    """
    texts = {c: non_null(F.col(c).cast("string")) for c in names}
    long = df.agg(*[F.coalesce(F.max(digits(t)), F.lit(0)).alias(f"n{i}") for i, t in enumerate(texts.values())]).first()
    too_long = {c for i, c in enumerate(names) if long[f"n{i}"] > MAX_DIGITS}
    if too_long:
        rest = [c for c in names if c not in too_long]
        return dict.fromkeys(too_long, False) | (monotonic_columns(df, ordinal, rest) if rest else {})
    numbers_of = [texts[c].try_cast("decimal(38,0)").alias(f"n{i}") for i, c in enumerate(names)]
    ranges = TotalOrder(df.select(F.col(ordinal).alias("__o"), *numbers_of), "__o").df
    before = Window.partitionBy(PART).orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)
    local = ranges.select(PART, *[x for i in range(len(names)) for x in (F.col(f"n{i}"), F.last(f"n{i}", ignorenulls=True).over(before).alias(f"p{i}"))])
    per_range = local.groupBy(PART).agg(*[x for i in range(len(names)) for x in (F.coalesce(F.bool_and(F.col(f"n{i}") >= F.col(f"p{i}")), F.lit(True)).alias(f"ok{i}"), F.min(f"n{i}").alias(f"lo{i}"), F.max(f"n{i}").alias(f"hi{i}"))])
    above = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    joined = per_range.select(*[(F.col(f"ok{i}") & F.coalesce(F.col(f"lo{i}") >= F.max(f"hi{i}").over(above), F.lit(True))).alias(f"ok{i}") for i in range(len(names))])
    row = joined.agg(*[F.coalesce(F.bool_and(f"ok{i}"), F.lit(True)).alias(f"ok{i}") for i in range(len(names))]).first()
    return dict(zip(names, map(bool, row), strict=True))


def monotonic(df: DataFrame, ordinal: str, value: str = "value") -> bool:
    return monotonic_columns(df, ordinal, [value])[value]


# --- delta and delta of delta ------------------------------------------------


def differences(df: DataFrame, ordinal: str, value: str = "value") -> TotalOrder:
    """(ordinal, n, d, dd): values, first and second differences; null where there is none.

    Integers are long where all have at most 18 digits, else decimal(38,0); more
    than MAX_DIGITS digits are an error.
    """
    kind = "long"
    if not isinstance(df.schema[value].dataType, T.IntegralType):
        most = df.agg(F.coalesce(F.max(digits(F.col(value).cast("string"))), F.lit(0))).first()[0]
        if most > MAX_DIGITS:
            raise ValueError(f"{value} has integers of over {MAX_DIGITS} digits")
        kind = "long" if most <= 18 else "decimal(38,0)"
    numbered = df.select(F.col(ordinal).alias("ordinal"), non_null(F.col(value).cast("string")).cast(kind).alias("n")).where("n IS NOT NULL")
    first = TotalOrder(numbered, "ordinal").lag("n", "before")
    second = first.with_column("d", F.col("n") - F.col("before")).lag("d", "d_before")
    return second.with_column("dd", F.col("d") - F.col("d_before"))


def delta_encoding(steps: DataFrame) -> str:
    """delta-of-delta if at most max(4, an eighth) of the second differences are distinct."""
    n, distinct = steps.agg(F.count("dd"), F.count_distinct("dd")).first()
    return "delta-of-delta" if n >= 1 and distinct <= max(4, n // 8) else "delta"


def undelta(first: int, steps: DataFrame, ordinal: str = "ordinal", value: str = "d") -> DataFrame:
    """(ordinal, n) from the first value and the differences; the row without one is the first."""
    filled = steps.select(F.col(ordinal).alias("ordinal"), F.coalesce(F.col(value), F.lit(0)).alias("d"))
    return TotalOrder(filled, "ordinal").running_sum("d", "sum").rows().select("ordinal", (F.col("sum") + F.lit(first)).alias("n"))


def undelta_of_delta(first: int, first_delta: int, steps: DataFrame, ordinal: str = "ordinal", value: str = "dd") -> DataFrame:
    """(ordinal, n) by two running sums. The first two rows have no second difference."""
    numbered = TotalOrder(steps.select(F.col(ordinal).alias("ordinal"), F.col(value).alias("dd")), "ordinal").row_number("k")
    summed = numbered.running_sum(F.coalesce("dd", F.lit(0)), "sum")
    delta = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.col("sum") + F.lit(first_delta))
    return summed.with_column("d", delta).running_sum("d", "total").rows().select("ordinal", (F.col("total") + F.lit(first)).alias("n"))


# --- bits --------------------------------------------------------------------


def pack_bits(df: DataFrame, index: str, flag: str | Column) -> DataFrame:
    """(byte, value): bit i % 8, lowest first, of byte i div 8; `index` counts from 0 without gaps."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    bit = F.when(flag, F.expr(f"shiftleft(1, CAST({index} % 8 AS INT))")).otherwise(0)
    return df.groupBy(F.floor(F.col(index) / 8).cast("long").alias("byte")).agg(F.sum(bit).cast("int").alias("value"))


def unpack_bits(packed: DataFrame, count: int) -> DataFrame:
    """(i, flag) for 0 <= i < count."""
    bits = packed.select("byte", "value", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    return bits.select((F.col("byte") * 8 + F.col("bit")).alias("i"), (F.expr("shiftright(value, bit)") % 2 == 1).alias("flag")).where(F.col("i") < count)


def null_bitmap(df: DataFrame, ordinal: str, value: str) -> DataFrame:
    """The packed flags of null values, in the order of `ordinal`."""
    numbered = TotalOrder(df.select(F.col(ordinal).alias("ordinal"), non_null(F.col(value).cast("string")).alias("value")), "ordinal").row_number("i")
    return pack_bits(numbered.rows(), "i", F.col("value").isNull())


def bit_pack(df: DataFrame, ordinal: str, value: str) -> DataFrame:
    """The packed booleans of the non-null values."""
    own = df.select(F.col(ordinal).alias("ordinal"), non_null(F.col(value).cast("string")).alias("value")).where("value IS NOT NULL")
    return pack_bits(TotalOrder(own, "ordinal").row_number("i").rows(), "i", numbers.as_boolean(F.col("value")))


def boolean_style(df: DataFrame, value: str) -> str:
    """word if any value is a word, else digit."""
    return "word" if df.agg(F.coalesce(F.bool_or(numbers.is_word(non_null(F.col(value).cast("string")))), F.lit(False))).first()[0] else "digit"


# --- dictionary --------------------------------------------------------------


def dictionary(df: DataFrame, value: str) -> DataFrame:
    """(code, value): the distinct non-null values in byte order, numbered from 0."""
    distinct = df.select(non_null(F.col(value).cast("string")).alias("value")).where("value IS NOT NULL").distinct()
    return TotalOrder(distinct, "value").row_number("code").rows().select("code", "value")


def dictionary_encode(df: DataFrame, ordinal: str, value: str, codes: DataFrame | None = None) -> DataFrame:
    """(ordinal, code) of the non-null values; Spark broadcasts the dictionary if it is small."""
    codes = dictionary(df, value) if codes is None else codes
    own = df.select(F.col(ordinal).alias("ordinal"), non_null(F.col(value).cast("string")).alias("value"))
    return own.join(codes, "value").select("ordinal", "code")


def dictionary_decode(encoded: DataFrame, codes: DataFrame) -> DataFrame:
    return encoded.join(codes, "code").select("ordinal", "value")


# --- runs --------------------------------------------------------------------


def rle_encode(df: DataFrame, ordinal: str, value: str) -> DataFrame:
    """(run, start, value, length): runs of equal non-null values; `start` is the first ordinal."""
    own = df.select(F.col(ordinal).alias("ordinal"), non_null(F.col(value).cast("string")).alias("value")).where("value IS NOT NULL")
    marked = TotalOrder(own, "ordinal").lag("value", "before")
    changed = F.when(F.col("before").isNull() | (F.col("before") != F.col("value")), F.lit(1)).otherwise(F.lit(0)).cast("long")
    runs = marked.with_column("changed", changed).running_sum("changed", "run").rows()
    return runs.groupBy("run").agg(F.min("ordinal").alias("start"), F.first("value").alias("value"), F.count(F.lit(1)).alias("length")).withColumn("run", F.col("run") - 1)


def rle_decode(runs: DataFrame) -> DataFrame:
    """(i, value): the values by position among the non-null ones."""
    placed = TotalOrder(runs.select("run", "value", "length"), "run").running_sum("length", "begin", inclusive=False).rows()
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(PIECE).cast("long")))
    pieces = placed.where("length > 0").select("value", "begin", "length", piece.alias("low"))
    at = F.explode(F.sequence(F.col("begin") + F.col("low"), F.col("begin") + F.least(F.col("low") + PIECE, F.col("length")) - 1))
    return pieces.select("value", at.alias("i")).select("i", "value")


def rle_encode_by(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs within groups: (keys, run, value, length). All groups lie in one total order, so that a large one is many ranges."""
    names = list(dict.fromkeys([*keys, *order, value]))
    own = F.struct(*keys, F.col(value).alias("__value"))
    marked = TotalOrder(df.select(*names), *dict.fromkeys([*keys, *order])).lag(own, "before")
    runs = marked.with_column("changed", F.when(F.col("before").eqNullSafe(own), 0).otherwise(1).cast("long")).running_sum("changed", "run").rows()
    summed = runs.groupBy(*keys, "run").agg(F.first(value).alias("value"), F.count(F.lit(1)).alias("length"))
    first = runs.groupBy(*keys).agg(F.min("run").alias("first_run")).select(*[F.col(k).alias(f"__{k}") for k in keys], "first_run")
    joined = summed.join(first, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]))
    return joined.select(*keys, (F.col("run") - F.col("first_run")).alias("run"), "value", "length")


# --- whole columns -----------------------------------------------------------


def reinsert_nulls(df: DataFrame, ordinal: str, value: str, decoded: DataFrame) -> DataFrame:
    """(ordinal, value): decoded non-null values (i, value) at the places where `df` is not null; '' elsewhere."""
    own = df.select(F.col(ordinal).alias("ordinal"), non_null(F.col(value).cast("string")).isNotNull().cast("long").alias("present"))
    placed = TotalOrder(own, "ordinal").running_sum("present", "i", inclusive=False).rows()
    at = F.when(F.col("present") == 1, F.col("i"))
    return placed.select("ordinal", at.alias("i")).join(decoded.select("i", "value"), "i", "left").select("ordinal", F.coalesce("value", F.lit("")).alias("value"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
