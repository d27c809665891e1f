"""Spark SQL expressions that take a combined-format log line apart.

Each function takes the name of a column (or another cheap expression) and gives
SQL text.
"""

from __future__ import annotations

from hedgewatch.functions.text import NON_SPACE, SPACE, quoted

# The two line formats. They differ in how the optional quoted
# fields may be separated: one blank against any run of whitespace.
_REQUEST = (
    rf'^({NON_SPACE}+) {NON_SPACE}+ {NON_SPACE}+ \[([^\]]+)\]'
    rf' "([A-Z]+) ([^ "]*) HTTP/[0-9.]+" (\d{{3}}) ({NON_SPACE}+)'
)
_QUOTED = r'("[^"]*")'
PATTERNS = {
    "nginx": rf"(?Us){_REQUEST}(?: {_QUOTED})?(?: {_QUOTED})?.*$",
    "apache": rf"(?Us){_REQUEST}(?:{SPACE}+{_QUOTED})?(?:{SPACE}+{_QUOTED})?.*$",
}
FIELDS = ("ip", "time", "method", "uri", "status", "size", "referer", "agent")
_MONTHS = "'jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'"
# The time layout "day/month/year:hour:minute:second offset". Numbers but the year may have one digit, the day then
# also a blank before it; any white space before an offset Z, +-hhmm[ss] or +-hh:mm[:ss] of less than a day.
_DAY, _HOUR, _SIXTY = "0[1-9]|[12][0-9]|3[01]", "2[0-3]|[01][0-9]", "[0-5][0-9]"
_USUAL_TIME = f"^(?:{_DAY})/[A-Za-z]{{3}}/[0-9]{{4}}:(?:{_HOUR}):{_SIXTY}:{_SIXTY} [+-](?:{_HOUR}){_SIXTY}$"
_ANY_TIME = (f"(?U)^(?: ?([1-9])|({_DAY}))/([A-Za-z]{{3}})/([0-9]{{4}}):({_HOUR}|[0-9]):({_SIXTY}|[0-9]):({_SIXTY}|[0-9])\\s+"
             f"(?:Z|([+-])({_HOUR})(?:({_SIXTY})({_SIXTY})?|:({_SIXTY})(?::({_SIXTY}))?))$")
# Written with a zero before each of the four numbers, which then goes where it makes three digits.
_PADDED = "0$1$2/$3/$4:0$5:0$6:0$7 $8$9$10$12$11$13"
_PAD = "(^|:)0([0-9]{2})(?=[/: ])"
# First character and length of the parts of the usual layout. The seconds of an offset may be missing, all of it is for Z.
_PLACES = {"day": (1, 2), "month": (4, 3), "year": (8, 4), "time": (13, 8), "sign": (22, 1), "offset_hour": (23, 2), "offset_minute": (25, 2),
           "offset_second": (27, 2)}


def split_line(line: str, source: str) -> str:
    """The fields of a line as an array, or a one-element array if it does not
    match. One pass of one pattern: the groups are written out separated by
    newlines, which a line cannot contain. Quotes stay on the optional fields so
    that a missing one (``''``) and an empty one (``'""'``) differ."""
    groups = "\n".join(f"${i}" for i in range(1, len(FIELDS) + 1))
    whens = " ".join(
        f"WHEN {quoted(name)} THEN split(regexp_replace({line}, {quoted(pattern)}, {quoted(groups)}), '\\n')"
        for name, pattern in PATTERNS.items())
    return f"CASE {source} {whens} END"


def optional(quoted_text: str, source: str) -> str:
    """An optional field without its quotes. Missing or ``-`` is NULL; an empty
    string stays in one format and is NULL in the other."""
    return (f"CASE WHEN {quoted_text} IN ('', '\"-\"') THEN NULL "
            f"WHEN {quoted_text} = '\"\"' THEN CASE WHEN {source} = 'nginx' THEN '' END "
            f"ELSE substring({quoted_text}, 2, length({quoted_text}) - 2) END")


def time_parts(text: str) -> str:
    """A time in the usual fixed layout, ``dd/Mon/yyyy:hh:mm:ss +hhmm[ss]``, or NULL for what is no time. Nothing follows the blank for Z."""
    padded = f"regexp_replace({text}, {quoted(_ANY_TIME)}, {quoted(_PADDED)})"
    return (f"CASE WHEN {text} RLIKE {quoted(_USUAL_TIME)} THEN {text} WHEN {text} RLIKE {quoted(_ANY_TIME)} "
            f"THEN regexp_replace({padded}, {quoted(_PAD)}, '$1$2') END")


def _part(parts: str, name: str) -> str:
    at, length = _PLACES[name]
    return f"substring({parts}, {at}, {length})"


def _month(parts: str) -> str:
    return f"CAST(array_position(array({_MONTHS}), lower({_part(parts, 'month')})) AS INT)"


def parse_time(parts: str, iso: str) -> str:
    """The instant of a ``time_parts`` column and its ``iso_time``, or NULL without a valid date."""
    def number(name: str) -> str:
        return f"coalesce(try_cast({_part(parts, name)} AS INT), 0)"

    offset = f"{number('offset_hour')} * 3600 + {number('offset_minute')} * 60 + {number('offset_second')}"
    local = f"try_cast(concat(left({iso}, 19), 'Z') AS TIMESTAMP)"
    return (f"CASE WHEN {_part(parts, 'year')} <> '0000' THEN timestampadd(SECOND, IF({_part(parts, 'sign')} = '-', 1, -1) * ({offset}), {local}) END")


def iso_time(parts: str) -> str:
    """ISO text in the original offset. The text, not the instant, is what alerts show and sort by. Numbers stay texts."""
    cut = {name: _part(parts, name) for name in _PLACES}
    zone = (f"CASE WHEN {cut['sign']} = '' THEN '+00:00' ELSE concat({cut['sign']}, {cut['offset_hour']}, ':', {cut['offset_minute']}, "
            f"CASE WHEN {cut['offset_second']} IN ('', '00') THEN '' ELSE concat(':', {cut['offset_second']}) END) END")
    return f"concat({cut['year']}, '-', lpad({_month(parts)}, 2, '0'), '-', {cut['day']}, 'T', {cut['time']}, {zone})"


def parse_size(text: str) -> str:
    """``-`` is 0; anything but an integer is NULL."""
    return (f"CASE WHEN {text} = '-' THEN 0L "
            f"WHEN {text} RLIKE {quoted('^[+-]?[0-9]+$')} THEN try_cast({text} AS BIGINT) END")


def uri_path(uri: str) -> str:
    return f"substring_index({uri}, '?', 1)"


def uri_query(uri: str) -> str:
    """Text after the first ``?``; NULL without one, empty after a final one."""
    return f"CASE WHEN contains({uri}, '?') THEN substring({uri}, instr({uri}, '?') + 1) END"


def looks_like_nginx(line: str) -> str:
    """The line ends, whitespace aside, with a quoted dash."""
    trailing = quoted(rf"(?U){SPACE}+$")
    return f"endswith(regexp_replace({line}, {trailing}, ''), '\"-\"')"
