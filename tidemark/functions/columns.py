"""Small expression builders shared by the operators. All stay inside codegen.

Expressions that come by the dozen are SQL text, parsed once per aggregate or
projection; that keeps the driver's share of a query short.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Money is summed in two parts, whole ten-thousandths and whole ten-billionths of what is left,
# both held in doubles: integer-valued doubles add exactly below 2**53, so totals do not depend on
# partition order. Amounts of up to four decimals leave nothing; an amount counts to ten decimals.
MONEY_SCALE = "10000D"
REST_SCALE = "1000000D"
MICROS_PER_SECOND = "1000000D"
SECONDS_PER_DAY = "86400D"


def ntz_text(moment: datetime) -> str:
    """A TIMESTAMP_NTZ literal, which folds and pushes down to the scan."""
    return f"timestamp_ntz'{moment.isoformat(sep=' ', timespec='microseconds')}'"


def ntz(moment: datetime) -> Column:
    return F.expr(ntz_text(moment))


def micros_between(start: str, end: str) -> str:
    """end - start in microseconds, null when either is null."""
    return f"timestampdiff(MICROSECOND, {start}, {end})"


def days(micros: str) -> str:
    """Fractional days of a microsecond count."""
    return f"({micros} / {MICROS_PER_SECOND} / {SECONDS_PER_DAY})"


def money_units(amount: str) -> str:
    """Amount in whole ten-thousandths; NaN counts as missing."""
    return f"rint({_scaled(amount)})"


def money_rest(amount: str) -> str:
    """What the whole ten-thousandths leave of an amount, in whole ten-billionths."""
    return f"rint(({_scaled(amount)} - {money_units(amount)}) * {REST_SCALE})"


def _scaled(amount: str) -> str:
    return f"(nanvl(CAST({amount} AS DOUBLE), NULL) * {MONEY_SCALE})"


def money(stem: str) -> str:
    """The sums ``<stem>_units`` and ``<stem>_rest`` back to an amount; nothing summed is zero."""
    whole, rest = f"coalesce({stem}_units, 0D)", f"coalesce({stem}_rest, 0D)"
    return f"({whole} / {MONEY_SCALE} + {rest} / ({MONEY_SCALE} * {REST_SCALE}))"


def round_half_even(value: Column, digits: int) -> Column:
    """Scale, round to the even neighbour, scale back."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def is_true(predicate: Column) -> Column:
    """A predicate in which an unknown answer counts as false."""
    return F.coalesce(predicate, F.lit(False))
