"""Percentiles of large numeric columns by radix selection on mergeable digit histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import salt, staged

MANTISSA_BITS = 52
_BIAS = 1023
#: Bits of a summary that is kept: sign, exponent and nine of the fraction.
SUMMARY_BITS = 21
#: Bits of the first digit of a selection: sign, exponent and six of the fraction.
FIRST_BITS = 18
#: Groups whose followed digits are broadcast, a short row each; beyond it they are shuffled, with salts.
BROADCAST_GROUPS = 200_000
SALTS = 16


def ordered_code(value: Column) -> Column:
    """64-bit integer in the order of `value`, a double: its IEEE bits, complemented below zero. -0 counts as 0, NaN gives null.

    Exact: the exponent is corrected for the rounding of log2, and scaling by powers of two doesn't round.
    """
    size = F.abs(value)
    guess = F.greatest(F.floor(F.log2(size)), F.lit(-_BIAS + 1)).cast("double")
    low = F.pow(F.lit(2.0), guess)
    exponent = guess + F.when(size < low, -1.0).when(size / low >= 2.0, 1.0).otherwise(0.0)
    small = size < 2.0 ** (1 - _BIAS)  # subnormal numbers have no leading bit
    mantissa = F.when(small, size * 2.0**537 * 2.0**537).otherwise((size / F.pow(F.lit(2.0), exponent) - 1.0) * 2.0**52)
    bits = F.when(small, F.lit(0).cast("bigint")).otherwise(F.shiftleft((exponent + _BIAS).cast("bigint"), MANTISSA_BITS)) + mantissa.cast("bigint")
    infinite = F.lit(2047 << MANTISSA_BITS).cast("bigint")
    code = F.when(size == 0, F.lit(0).cast("bigint")).when(size == float("inf"), infinite).otherwise(bits)
    return F.when(F.isnan(value) | value.isNull(), F.lit(None).cast("bigint")).otherwise(F.when(value < 0, -code - 1).otherwise(code))


def coded_value(code: Column) -> Column:
    """The double whose `ordered_code` this is."""
    bits = F.when(code < 0, -code - 1).otherwise(code)
    exponent = F.shiftright(bits, MANTISSA_BITS)
    mantissa = bits.bitwiseAND(F.lit((1 << MANTISSA_BITS) - 1)).cast("double")
    normal = (mantissa * 2.0**-52 + 1.0) * F.pow(F.lit(2.0), (exponent - _BIAS).cast("double"))
    size = F.when(exponent == 0, mantissa * 2.0**-537 * 2.0**-537).when(exponent >= 2047, F.lit(float("inf"))).otherwise(normal)
    return F.when(code < 0, -size).otherwise(size)


def _codes(df: DataFrame, keys: list[str], value: str, part: str | None = None) -> DataFrame:
    """The keys as _g0.., the part as _part, and _code; without null and NaN values."""
    named = [F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]
    return df.select(*named, *([F.col(part).alias("_part")] if part else []), ordered_code(F.col(value).cast("double")).alias("_code")).filter("_code is not null")


def digit_histogram(df: DataFrame, keys: list[str], value: str, bits: int = SUMMARY_BITS) -> DataFrame:
    """Mergeable summary: keys, prefix (the leading `bits` bits of the ordered code), n.

    Summaries of parts (partitions, days) are merged by `merge`. Null and NaN values are left out, null keys are keys. Values of a prefix
    differ relatively by less than 2 ** (12 - bits), 2 ** -9 by default; a key has at most 2 ** (bits - 12) rows for each power of two that
    its values span and each sign, however many values it has.
    """
    prefix = F.shiftright(ordered_code(F.col(value).cast("double")), 64 - bits)
    return df.select(*keys, prefix.alias("prefix")).filter("prefix is not null").groupBy(*keys, "prefix").agg(F.count(F.lit(1)).alias("n"))


def merge(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """One summary of several: counts of the same keys and prefix added up. Further columns, as the day, are merged away."""
    return summaries.groupBy(*keys, "prefix").agg(F.sum("n").alias("n"))


def _check_names(keys: list[str], percents: dict[str, int]) -> None:
    if {"n", "prefix"} & {*keys} or {"n", *keys} & {*percents}:
        raise ValueError("n and prefix are names of the summary's own columns")


def _wanted(counts: DataFrame, own: list[str], percents: dict[str, int]) -> DataFrame:
    """_total and the wanted ranks of each group, a row per group and percent."""
    names = F.array(*[F.struct(F.lit(name).alias("_name"), F.ceil(F.col("_total") * F.lit(p) / F.lit(100)).cast("bigint").alias("_rank")) for name, p in percents.items()])
    return counts.groupBy(*own).agg(F.sum("_n").alias("_total")).select(*own, "_total", F.explode(names).alias("_w")).select(*own, "_total", "_w.*")


def _followed(digits: DataFrame, chosen: DataFrame, own: list[str], head: bool) -> DataFrame:
    """The digit that holds each wanted rank, as _head, with the rank inside of it. With `head` digits count within the chosen heads."""
    a, b = digits.alias("a"), chosen.alias("b")
    same = [F.col(f"a.{o}").eqNullSafe(F.col(f"b.{o}")) for o in own] + ([F.col("a._in") == F.col("b._head")] if head else [])
    met = a.join(b, same) if same else a.crossJoin(b)  # without keys both have a bounded number of rows
    met = met.select(*[F.col(f"b.{o}").alias(o) for o in own], "_total", "_name", "_rank", "_digit", "_n")
    upto = F.sum("_n").over(Window.partitionBy(*own, "_name").orderBy("_digit"))
    met = met.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
    return met.select(*own, "_total", "_name", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), F.col("_digit").alias("_head"))


def _shown(chosen: DataFrame, keys: list[str], own: list[str], percents: dict[str, int], bits: int) -> DataFrame:
    rest = F.shiftleft(F.col("_head"), 64 - bits)
    smallest = F.when(F.col("_head") < 0, rest + F.lit((1 << (64 - bits)) - 1)).otherwise(rest)
    found = chosen.select(*own, "_total", "_name", coded_value(smallest).alias("_value"))
    out = found.groupBy(*own, "_total").agg(*[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in percents])
    return out.select(*[F.col(o).alias(k) for o, k in zip(own, keys)], F.col("_total").alias("n"), *percents)


def select_percentiles(summary: DataFrame, keys: list[str], percents: dict[str, int], bits: int = SUMMARY_BITS) -> DataFrame:
    """Percentiles of each group of a merged summary: keys, n, one column per entry of `percents` (name: percent, 1..100).

    The percentile is the value of rank ceil(n * percent / 100), known to its prefix: of the values that share it their smallest in
    size is given, so the relative error is below 2 ** (12 - bits).
    """
    _check_names(keys, percents)
    own = [f"_g{i}" for i in range(len(keys))]
    counts = staged(summary.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col("prefix").alias("_digit"), F.col("n").alias("_n")), "summary")
    return _shown(_followed(counts, _wanted(counts, own, percents), own, False), keys, own, percents, bits)


def _within_heads(codes: DataFrame, chosen: DataFrame, own: list[str], left: int) -> DataFrame:
    """The rows of `codes` whose leading bits, without the last `left`, are a chosen head of their group, with them as _in."""
    heads = staged(chosen.groupBy(*own).agg(F.collect_set("_head").alias("_heads")), "heads")  # as many heads as percents
    named = heads.select(*[F.col(o).alias(f"_h{o}") for o in own], "_heads")
    same = [F.col(o).eqNullSafe(F.col(f"_h{o}")) for o in own]
    rows = codes.withColumn("_in", F.shiftright("_code", left))
    if heads.count() <= BROADCAST_GROUPS:
        named = F.broadcast(named)
    else:  # a group may hold a third of all rows
        named = named.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows, same = rows.withColumn("_salt", salt("_code", *own, salts=SALTS)), [*same, F.col("_salt") == F.col("_s")]
    met = rows.join(named, same) if same else rows.crossJoin(named)  # without keys there is one row of heads
    return met.filter(F.array_contains("_heads", F.col("_in")))


def percentiles(df: DataFrame, keys: list[str], value: str, percents: dict[str, int], part: str | None = None, bits: int = 36, digit_bits: int = 9) -> DataFrame:
    """Percentiles of each group of `df`: keys, n, one column per entry of `percents`; relative error below 2 ** (12 - bits).

    Radix selection: the leading digit (sign, exponent and the first bits of the fraction, FIRST_BITS in all) is histogrammed per group,
    the digit that holds each wanted rank is followed, then the next digit of `digit_bits` bits is histogrammed over the rows within the
    followed digits only, and so on. Each digit is a pass over the columns it needs of `df`. A pass has at most 2 ** digit_bits rows per
    group and percent, whatever the values. With `part` (a day) each pass counts per part and adds the parts up, as separate parts would.

    Groups without a value give no row; an empty table gives none.
    """
    if bits < FIRST_BITS or (bits - FIRST_BITS) % digit_bits:
        raise ValueError(f"bits must be {FIRST_BITS} and a multiple of digit_bits")
    _check_names(keys, percents)
    own = [f"_g{i}" for i in range(len(keys))]
    codes = _codes(df, keys, value, part)

    def histogram(rows: DataFrame, by: list[str]) -> DataFrame:
        counted = rows.groupBy(*own, *(["_part"] if part else []), *by, "_digit").agg(F.count(F.lit(1)).alias("_n"))
        return counted.groupBy(*own, *by, "_digit").agg(F.sum("_n").alias("_n")) if part else counted

    counts = staged(histogram(codes.withColumn("_digit", F.shiftright("_code", 64 - FIRST_BITS)), []), "digits")
    chosen = staged(_followed(counts, _wanted(counts, own, percents), own, False), "chosen")
    for upto in range(FIRST_BITS + digit_bits, bits + 1, digit_bits):
        inside = _within_heads(codes, chosen, own, 64 - upto + digit_bits).withColumn("_digit", F.shiftright("_code", 64 - upto))
        chosen = staged(_followed(histogram(inside, ["_in"]), chosen, own, True), "chosen")
    return _shown(chosen, keys, own, percents, bits)
