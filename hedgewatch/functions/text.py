"""Text helpers shared by every stage, all built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace as Unicode text tools see it: the White_Space property plus the
# four ASCII separators. Patterns that use it need the (?U) flag.
SPACE = r"[\s\x1c-\x1f]"
NON_SPACE = r"[^\s\x1c-\x1f]"

_STRIP = f"(?U)^{SPACE}+|{SPACE}+$"
_STRAY_PERCENT = "%(?![0-9A-Fa-f]{2})"


def quoted(value: str) -> str:
    """A string as a Spark SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip_sql(name: str) -> str:
    """Remove Unicode whitespace at both ends of column or lambda variable
    ``name``. Text that starts and ends with a visible ASCII character skips the
    regular expression."""
    return (f"CASE WHEN left({name}, 1) BETWEEN '!' AND '~' AND right({name}, 1) BETWEEN '!' AND '~' "
            f"THEN {name} ELSE regexp_replace({name}, {quoted(_STRIP)}, '') END")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _STRIP, "")


def percent_decode_sql(name: str) -> str:
    """Percent-decode column or lambda variable ``name`` once. ``+`` stays, a stray
    ``%`` stays, bytes that are not UTF-8 become U+FFFD. Text without ``%`` is
    passed through."""
    return (f"CASE WHEN contains({name}, '%') THEN try_url_decode(regexp_replace("
            f"replace({name}, '+', '%2B'), {quoted(_STRAY_PERCENT)}, '%25')) ELSE {name} END")


def decode_columns(df: DataFrame, names: list[str], times: int) -> DataFrame:
    """Percent-decode columns ``times`` times, one projection per pass, so that
    no pass is evaluated more than once."""
    for _ in range(times):
        df = df.withColumns({n: F.expr(percent_decode_sql(n)) for n in names})
    return df


def non_empty(c: Column) -> Column:
    """NULL for an empty string."""
    return F.nullif(c, F.lit(""))


def list_literal(items: Column) -> Column:
    """An array of strings as ``['a', 'b']``; backslashes and quotes are escaped
    the way the list notation of the verdict request does it."""
    def quoted(s: Column) -> Column:
        s = F.replace(s, F.lit("\\"), F.lit("\\\\"))
        has_single = F.contains(s, F.lit("'"))
        has_double = F.contains(s, F.lit('"'))
        return (
            F.when(has_single & ~has_double, F.concat(F.lit('"'), s, F.lit('"')))
            .when(has_single, F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'")))
            .otherwise(F.concat(F.lit("'"), s, F.lit("'")))
        )
    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def lookup(c: Column, table: dict, default: Column | None = None) -> Column:
    """Constant table lookup; ``c`` is evaluated once. NULL or ``default`` for what
    is not in the table."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(entries, c)
    return found if default is None else F.coalesce(found, default)
