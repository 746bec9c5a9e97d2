"""Best-effort typing of text cells. Each parser gives NULL for what it cannot read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings rewritten to the ISO form: (what the text looks like, its rewriting).
_TO_ISO = (
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})(.*)$", "$1-$2-$3$4"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(.*)$", "$3-$1-$2$4"),
    (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (r"^[A-Za-z]{3}, (.*)$", "$1"),
)
# Forms with a month name.
_NAMED_MONTH = ("dd MMM yyyy HH:mm:ss[ Z]", "dd-MMM-yyyy HH:mm:ss[ Z]")


def best_effort_timestamp(text: Column) -> Column:
    """ISO forms first, then epoch seconds or milliseconds, other date orders, month names."""
    cell = F.trim(text)
    digits = cell.rlike(r"^\d+$")
    # A bare run of digits is an epoch or a packed date, never a year.
    iso = F.when(~digits, F.try_to_timestamp(cell))
    epoch = F.when(digits & F.length(cell).between(9, 10), F.timestamp_seconds(cell.try_cast("long"))).when(
        digits & (F.length(cell) == 13), F.timestamp_millis(cell.try_cast("long"))
    )
    rewritten = cell
    for look, form in _TO_ISO:
        rewritten = F.regexp_replace(rewritten, look, form)
    other = F.when(~rewritten.rlike(r"^\d+$"), F.try_to_timestamp(rewritten))
    named = [F.try_to_timestamp(rewritten, F.lit(f)) for f in _NAMED_MONTH]
    # Every failed attempt costs an exception, so absent cells make none.
    return F.when(cell != "", F.coalesce(iso, epoch, other, *named))


def best_effort_uint(text: Column, bits: int) -> Column:
    """Unsigned integer of the given width; signs, fractions and overflow do not count."""
    value = F.when(text.rlike(r"^\d+$"), text.try_cast("long"))
    return F.when(value < (1 << bits), value).cast("int" if bits < 32 else "long")


# Money and scores beyond this are no readings; sums of fixed-point units stay far from overflow below it.
FLOAT_BOUND = 1e6


def best_effort_float(text: Column) -> Column:
    """A finite number of plausible size; ``NaN``, infinities and absurd amounts do not count."""
    value = F.when(F.trim(text) != "", text.try_cast("double"))
    return F.when(F.abs(value) <= FLOAT_BOUND, value)
