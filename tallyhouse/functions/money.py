"""Exact money and quantity parsing, and integer means.

Amounts are whole minor units in BIGINT throughout. Text is read through DECIMAL, never
through a float, and anything that is not a whole penny is NULL so the caller can report it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.functions.text import SPACES, stripped

# Fixed value: accepted shape of a quantity cell.
QUANTITY_SHAPE = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
# Fixed value: accepted shape of a money cell. Past two decimals only zeros are whole pence.
MONEY_SHAPE = (
    rf"^-?[{SPACES}]*£?[{SPACES}]*-?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)(\.[0-9]{{1,2}}0*)?\z")


def money_to_pence(raw: Column) -> Column:
    """Pence as BIGINT; blank is 0, and NULL marks a malformed or sub-penny cell."""
    return clean_pence(stripped(raw))


def clean_pence(text: Column) -> Column:
    """The same for text already stripped; a column, because it is used several times.

    A cell is a minus, a pound sign, a second minus, whole digits with or without thousands
    commas and a decimal part, all but the whole digits optional. Two minuses cancel out.
    """
    # The shape is tested once; a cell that has it is digits after its signs and blanks, so
    # what follows are plain cuts and not steps that each repeat the ones before.
    number = F.replace(F.ltrim(text, F.lit("-£" + SPACES)), F.lit(","), F.lit(""))
    whole = F.substring_index(number, ".", 1)
    cents = F.substring(number, F.length(whole) + 2, F.lit(2))
    two_places = F.substring(text, -3, 1) == "."
    pence = F.when(two_places, F.replace(number, F.lit("."), F.lit(""))).otherwise(
        F.concat(whole, F.rpad(cents, 2, "0"))).try_cast("bigint")
    negative = F.length(F.replace(text, F.lit("-"), F.lit(""))) == F.length(text) - 1
    return F.when(text == "", F.lit(0).cast("bigint")).when(
        text.rlike(MONEY_SHAPE), F.when(negative, -pence).otherwise(pence))


def whole_quantity(raw: Column) -> Column:
    """Units as BIGINT; NULL for a blank, malformed or fractional cell."""
    return clean_quantity(stripped(raw))


def clean_quantity(text: Column) -> Column:
    value = text.try_cast("decimal(38,10)")
    # The cast rounds past its scale, so a plain fraction is looked for in the text as well.
    fraction = (value != F.floor(value)) | text.rlike(r"^[^eE]*\.\d*[1-9]\d*$")
    return F.when(text.rlike(QUANTITY_SHAPE) & ~fraction, value.try_cast("bigint"))


def _half_up_quotient(total: Column, count: Column) -> Column:
    """|total| / count rounded half up, in integer arithmetic (count > 0)."""
    half = F.call_function("div", count, F.lit(2))
    return F.call_function("div", F.abs(total) + half, count)


def unit_price(line_total: Column, quantity: Column) -> Column:
    """Positive price per unit from the magnitudes; NULL for zero quantity."""
    return F.when(quantity != 0, _half_up_quotient(line_total, F.abs(quantity)))


def _signed_mean(total: Column, count: Column) -> Column:
    mean = _half_up_quotient(total, count)
    return F.when(total < 0, -mean).otherwise(mean)


def mean_pence(total: Column, count: Column) -> Column:
    """Mean rounded half away from zero; 0 where nothing was counted."""
    return F.when(count == 0, F.lit(0).cast("bigint")).otherwise(_signed_mean(total, count))


def selling_price(net: Column, units: Column) -> Column:
    """Net pence per unit rounded half away from zero; NULL unless units are positive."""
    return F.when(units > 0, _signed_mean(net, units))
