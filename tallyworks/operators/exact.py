"""Sums of doubles that do not depend on the order of the rows; built-in functions only.

A double is a whole number of units of a power of two. It is cut into four digits of 20 bits, the first at the
bin its size falls into, and the digits are added as whole numbers per key and bin, which is exact. The few bins of
a key are then joined: digits of one place are added, carried upwards, and the total is rounded to the nearest double once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Bits of a digit, and the digits that the 53 bits of a double can touch.
BITS = 20
DIGITS = 4
# Doubles below 2**-500 are moved up by so many places, so that no power of two overflows.
SMALL, MOVED = 2.0**-500, 27
# With more rows of a key the digits' sums might not fit a long.
MOST_ROWS = 1 << 41


def _power(places: Column) -> Column:
    """2 to the power of a number of places times the bits of each, from a table, for what is a normal double."""
    powers = ", ".join(f"{2.0 ** (BITS * place)!r}D" for place in range(-51, 52))
    return F.element_at(F.expr(f"array({powers})"), places.cast("int") + 52)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scaled(amount: Column) -> tuple[Column, Column]:
    """The bin of a finite double, and its size in units of that bin. Zero is in a bin like one."""
    size = F.abs(amount)
    small = size < SMALL
    scaled = F.when(small, size * 2.0 ** (BITS * MOVED)).otherwise(size)
    # The logarithm may miss a bin by one next to its edge; the digits then still make up the double.
    place = F.when(size > 0, F.floor(F.log2(scaled) * (1 / BITS))).otherwise(F.lit(0)).cast("int")
    return place, scaled


def _digits(units: Column, sign: Column) -> list[Column]:
    """Four digits of a size in units of its bin, each with the sign: whole units, and 20 bits at a time below."""
    step = float(1 << BITS)
    first, second, third = F.floor(units), F.floor(units * step), F.floor(units * step * step)
    fourth = F.floor((units * step * step - third.cast("double")) * step)
    return [sign * digit for digit in (first, second - F.shiftleft(first, BITS), third - F.shiftleft(second, BITS), fourth)]


def _joined(bins: Column) -> Column:
    """The double nearest to what the bins of a key add up to."""
    least, most = F.array_min(bins["bin"]) - DIGITS + 1, F.array_max(bins["bin"]) + DIGITS

    def at(place: Column) -> Column:
        def here(total: Column, one: Column) -> Column:
            number = one["bin"] - place
            digit = F.lit(0).cast("bigint")
            for which in range(DIGITS):
                digit = F.when(number == which, one[f"d{which}"]).otherwise(digit)
            return total + digit

        return F.aggregate(bins, F.lit(0).cast("bigint"), here)

    sums = F.transform(F.sequence(least, most), at)

    def carried(sign: int) -> Column:
        """Digits from 0 to 2**20 - 1, the lowest first, and what is carried beyond: 0, or -1 for a total below zero."""
        start = F.struct(F.lit(0).cast("bigint").alias("over"), F.array().cast("array<bigint>").alias("digits"))

        def step(held: Column, own: Column) -> Column:
            total = held["over"] + sign * own
            digit = F.array(total.bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint")))
            return F.struct(F.shiftright(total, BITS).alias("over"), F.concat(held["digits"], digit).alias("digits"))

        return F.aggregate(sums, start, step)

    def rounded(digits: Column) -> Column:
        """The first five digits that are not zero hold more bits than a double; of those below, only whether any is set counts."""
        top = F.size(digits) - F.array_position(F.reverse(F.transform(digits, lambda digit: digit > 0)), True).cast("int")

        def number(which: int) -> Column:
            digit = F.coalesce(F.get(digits, top - which), F.lit(0).cast("bigint"))
            return digit.cast("decimal(7,0)") * F.lit(str(1 << (BITS * (4 - which)))).cast("decimal(25,0)")

        whole = sum((number(which) for which in range(1, 5)), number(0))
        lower = F.exists(F.slice(digits, F.lit(1), F.greatest(top - 4, F.lit(0))), lambda digit: digit > 0)
        odd = F.get(digits, top - 4).bitwiseAND(F.lit(1).cast("bigint")) == 1
        whole = whole + F.when(lower & ~F.coalesce(odd, F.lit(False)), F.lit(1)).otherwise(F.lit(0)).cast("decimal(1,0)")
        places = least + top - 4
        half = F.floor(places / 2).cast("int")
        value = whole.cast("double") * _power(half) * _power(places - half)
        return F.when(F.exists(digits, lambda digit: digit > 0), value).otherwise(F.lit(0.0))

    def signed(total: Column) -> Column:
        below = total["over"] < 0
        digits = F.when(below, carried(-1)["digits"]).otherwise(total["digits"])
        return _let(digits, rounded) * F.when(below, F.lit(-1.0)).otherwise(F.lit(1.0))

    return _let(carried(1), signed)


def exact_total_by(frame: DataFrame, key: str, amount: str, name: str) -> DataFrame:
    """Sum of a column of doubles per key, the exact total rounded once: any order and any partitioning give the same bits.

    Null amounts are skipped; a key with only nulls has a null total, and a null key is a key. A total of zero is 0.0. NaN, or
    infinities of both signs, make a total NaN; one infinity is the total; a total beyond the largest double is infinite. More than
    ``MOST_ROWS`` rows of a key fail. Each task adds its rows up per key and bin, of which a key has 106 at most, before the shuffle.
    """
    value = F.col(f"`{amount}`").cast("double")
    key_column = F.col(f"`{key}`")
    finite = F.when(F.abs(value) < float("inf"), value)
    flagged = frame.select(
        key_column.alias(key),
        finite.alias("_amount"),
        F.isnan(value).alias("_nan"),
        (value == float("inf")).alias("_above"),
        (value == float("-inf")).alias("_below"),
        value.isNotNull().alias("_known"),
    )
    # Columns that are used more than once are made one after the other, so that each is computed once.
    place, scaled = _scaled(F.col("_amount"))
    placed = flagged.withColumn("_place", place).withColumn("_scaled", scaled)
    placed = placed.withColumn("_units", F.col("_scaled") * _power(-F.col("_place")))
    sign = F.when(F.col("_amount") < 0, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    own_bin = F.col("_place") - F.when(F.abs("_amount") < SMALL, MOVED).otherwise(0)
    digits = [digit.alias(f"_d{which}") for which, digit in enumerate(_digits(F.col("_units"), sign))]
    rows = placed.select(f"`{key}`", F.when(F.col("_amount").isNotNull(), own_bin).alias("_bin"), *digits, "_nan", "_above", "_below", "_known")
    flags = ["_nan", "_above", "_below", "_known"]
    by_bin = rows.groupBy(f"`{key}`", "_bin").agg(
        *[F.sum(f"_d{which}").alias(f"d{which}") for which in range(DIGITS)], F.count("*").alias("_n"), *[F.max(flag).alias(flag) for flag in flags]
    )
    held = F.struct(F.col("_bin").alias("bin"), *[F.col(f"d{which}").alias(f"d{which}") for which in range(DIGITS)])
    by_key = by_bin.groupBy(f"`{key}`").agg(
        F.array_sort(F.collect_list(F.when(F.col("_bin").isNotNull(), held))).alias("_bins"),
        F.sum("_n").alias("_n"),
        *[F.coalesce(F.max(flag), F.lit(False)).alias(flag) for flag in flags],
    )
    many = F.raise_error(F.lit(f"more than {MOST_ROWS} rows of one key")).cast("double")
    total = (
        F.when(F.col("_n") > MOST_ROWS, many)
        .when(~F.col("_known"), F.lit(None).cast("double"))
        .when(F.col("_nan") | (F.col("_above") & F.col("_below")), F.lit(float("nan")))
        .when(F.col("_above"), F.lit(float("inf")))
        .when(F.col("_below"), F.lit(float("-inf")))
        .otherwise(_joined(F.col("_bins")))
    )
    return by_key.select(F.col(f"`{key}`"), total.alias(name))
