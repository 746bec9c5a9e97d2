"""Internet addresses from free text, by column expressions only.

Version 4 is four decimal numbers without leading zeros. Version 6 is eight groups of up to four hex digits, of which one run of zero groups may
be left out and the last two may be written as version 4; a zone (``%eth0``) may follow. Every spelling of an address has the same canonical text: lower case, no
leading zeros, the longest run of two or more zero groups left out (the first of equals), and mapped version 4 addresses as ``::ffff:a.b.c.d``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"
_GROUPS = "[0-9a-f]{1,4}(:[0-9a-f]{1,4})*"
_V6 = f"^(({_GROUPS})?::({_GROUPS})?|{_GROUPS})$"
_MAPPED = "^0:0:0:0:0:ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _octet(text: Column, i: int) -> Column:
    return F.regexp_extract(text, f"(^|:){_V4}$", i + 2).try_cast("int")


def _hex_pair(high: Column, low: Column) -> Column:
    return F.lower(F.hex(high * 256 + low))


def _eight_groups(text: Column) -> Column:
    """All eight groups of a version-6 address without leading zeros, or NULL."""
    as_groups = F.concat(_hex_pair(_octet(text, 0), _octet(text, 1)), F.lit(":"), _hex_pair(_octet(text, 2), _octet(text, 3)))
    hex_only = F.when(F.contains(text, F.lit(".")), F.concat(F.regexp_replace(text, f"(?<=:){_V4}$", ""), as_groups)).otherwise(text)

    def filled(plain: Column) -> Column:
        colons = F.length(plain) - F.length(F.replace(plain, F.lit(":"), F.lit("")))
        at_an_end = F.startswith(plain, F.lit("::")).cast("int") + F.endswith(plain, F.lit("::")).cast("int")
        short = F.contains(plain, F.lit("::"))

        def whole(present: Column) -> Column:
            zeros = F.repeat(F.lit("0:"), F.greatest(8 - present, F.lit(0)))
            spelled = F.regexp_replace(F.replace(plain, F.lit("::"), F.concat(F.lit(":"), zeros)), "^:|:$", "")
            return F.when(short & (present <= 7), spelled).when(~short & (present == 8), plain)

        groups = _let(F.when(short, colons - at_an_end).otherwise(colons + 1), whole)
        return F.when(plain.rlike(_V6), F.regexp_replace(groups, "(^|:)0+(?=[0-9a-f])", "$1"))

    return _let(hex_only, filled)


def _compressed(groups: Column) -> Column:
    """The longest run of zero groups left out."""

    def shortened(joined: Column) -> Column:
        out = groups
        for n in range(2, 9):  # longer runs are looked at last, and win
            run = ":0" * n + ":"
            at = F.instr(joined, run)
            before = F.when(at > 1, F.substring(joined, F.lit(2), at - 2)).otherwise("")
            after = F.regexp_replace(F.substring(joined, at + len(run), F.length(joined)), ":$", "")
            out = F.when(at > 0, F.concat(before, F.lit("::"), after)).otherwise(out)
        return out

    return _let(F.concat(F.lit(":"), groups, F.lit(":")), shortened)


def _dotted(groups: Column) -> Column:
    """A mapped version-4 address as it is usually written."""
    high, low = (F.conv(F.regexp_extract(groups, _MAPPED, i), 16, 10).try_cast("int") for i in (1, 2))
    parts = [F.shiftright(high, 8), high.bitwiseAND(255), F.shiftright(low, 8), low.bitwiseAND(255)]
    return F.concat(F.lit("::ffff:"), F.concat_ws(".", *[p.cast("string") for p in parts]))


def canonical_ip(text: Column | str) -> Column:
    """Canonical text of an IPv4 or IPv6 address, NULL for anything else."""
    text = F.col(text) if isinstance(text, str) else text
    # The zone keeps its case.
    zone = F.regexp_extract(text, "(%[^%]+)$", 1)
    bare = F.lower(F.substring(text, F.lit(1), F.length(text) - F.length(zone)))
    v6 = _let(_let(bare, _eight_groups), lambda groups: F.when(groups.rlike(_MAPPED), _dotted(groups)).otherwise(_compressed(groups)))
    return F.when(text.rlike(f"^{_V4}$"), text).when(F.contains(text, F.lit(":")), F.concat(v6, zone))


def one_spelling(text: Column) -> Column:
    """The canonical text of an address, and any other text trimmed."""
    bare = F.trim(text)
    return F.when(F.contains(bare, F.lit(":")), F.coalesce(canonical_ip(bare), bare)).otherwise(bare)


def address_candidates(lines: DataFrame, column: str) -> DataFrame:
    """Split free text on blanks, commas and semicolons; one row per distinct piece."""
    pieces = F.explode(F.split(F.col(column), r"[\s,;]+"))
    return (
        lines.select(pieces.alias("candidate"))
        .where(F.col("candidate") != "")
        .distinct()
        .withColumn("termination_media_ip", canonical_ip("candidate"))
    )


def parse_addresses(lines: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Valid distinct addresses, and the pieces that are none."""
    found = address_candidates(lines, column)
    valid = found.where(F.col("termination_media_ip").isNotNull()).select("termination_media_ip").distinct()
    rejects = found.where(F.col("termination_media_ip").isNull()).select("candidate")
    return valid, rejects
