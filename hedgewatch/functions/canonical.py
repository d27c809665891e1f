"""The canonical request key and the token masks it is built from.

Texts are decoded step by step in separate projections (or separate ``transform``
calls within an array), so no step is evaluated twice; nothing leaves the JVM.
"""

from __future__ import annotations

from functools import reduce
from re import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgewatch import config
from hedgewatch.functions.once import with_columns_once
from hedgewatch.functions.text import decode_columns, percent_decode_sql, quoted, strip_sql


_NUMBER_SEGMENT = r"(?Ud)/\d+(?=/|$)"


def mask_steps(blob_length: int) -> tuple[tuple[str, str], ...]:
    """Pattern and replacement of each masking step; their order matters."""
    hosts = "|".join(escape(h) for h in config.INTERNAL_HOSTS)
    return (
        (r"(?U)\b[0-9a-f]{16,}\b", "{hash}"),
        (rf"(?iU)\b[a-z0-9+/]{{{blob_length},}}={{0,2}}\b", "{encoded}"),
        (r"(?U)\b\d{1,3}(?:\.\d{1,3}){3}\b", "{ip}"),
        (rf"(?U)\b(?:{hosts})\b", "{internal_host}"),
        (r"(?U)\b\d+\b", "{num}"),
    )


def mask(name: str, blob_length: int) -> str:
    """SQL that masks volatile tokens of a decoded, lower-cased, stripped text. The
    chain is linear: every step refers to the one before exactly once."""
    return reduce(lambda out, step: f"regexp_replace({out}, {quoted(step[0])}, {quoted(step[1])})",
                  mask_steps(blob_length), name)


def with_masked_token(df: DataFrame, column: str, out: str,
                      blob_length: int = config.KEY_BLOB_LENGTH) -> DataFrame:
    """``out`` = ``column`` decoded twice, lower-cased, stripped and masked. Values
    of one payload are kept apart, volatile ones are not."""
    staged = decode_columns(df.withColumn(out, F.coalesce(column, F.lit(""))), [out], times=2)
    for step in (f"lower({out})", strip_sql(out), mask(out, blob_length)):
        staged = staged.withColumn(out, F.expr(step))
    return staged


def with_payload_family(df: DataFrame, column: str, out: str = "payload_family") -> DataFrame:
    """``{family}`` of the first payload family the masked text shows, else the
    masked text."""
    staged = with_masked_token(df, column, "__token", config.FAMILY_BLOB_LENGTH)
    whens = " ".join(f"WHEN __token RLIKE {quoted('(?Ud)' + pattern)} THEN '{{{family}}}'"
                     for family, pattern in config.PAYLOAD_FAMILIES)
    return staged.withColumn(out, F.expr(f"CASE {whens} ELSE __token END")).drop("__token")


def query_pairs(query: str) -> str:
    """SQL for the sorted key/value structs of a decoded query in normal form. Parts
    without any text are dropped, parts without ``=`` have an empty value, ``+`` is
    a blank. One ``transform`` per step."""
    pair = ("named_struct('key', CASE WHEN contains(p, '=') THEN left(p, instr(p, '=') - 1) ELSE p END, "
            "'value', CASE WHEN contains(p, '=') THEN substring(p, instr(p, '=') + 1) ELSE '' END)")
    pairs = f"transform(filter(split({query}, '&'), p -> p <> ''), p -> {pair})"
    decode = percent_decode_sql
    steps = (
        ("replace(s.key, '+', ' ')", "replace(s.value, '+', ' ')"),
        (decode("s.key"), decode("s.value")),  # the pair parse decodes once,
        ("lower(s.key)", decode("s.value")),   # the value mask twice more
        ("s.key", decode("s.value")),
        ("s.key", "lower(s.value)"),
        ("s.key", strip_sql("s.value")),
        ("s.key", mask("s.value", config.KEY_BLOB_LENGTH)),
    )
    for key, value in steps:
        pairs = f"transform({pairs}, s -> named_struct('key', {key}, 'value', {value}))"
    return f"array_sort({pairs})"


def with_canonical_key(df: DataFrame, out: str = "canonical_key") -> DataFrame:
    """Add the canonical key ``METHOD path?query ua=family``, from ``method``,
    ``path``, ``query_string`` and ``user_agent`` alone."""
    kept = [f"`{c}`" for c in df.columns if c != out]
    staged = df.selectExpr(*kept, "coalesce(path, '') AS __path", "coalesce(query_string, '') AS __query",
                           "coalesce(user_agent, '') AS __agent")
    staged = decode_columns(staged, ["__path", "__query", "__agent"], times=2)
    path = "regexp_replace(coalesce(nullif(lower(__path), ''), '/'), '/+', '/')"
    path = f"regexp_replace({path}, {quoted(_NUMBER_SEGMENT)}, '/{{id}}')"
    path = f"regexp_replace({path}, '(?d)/[0-9a-f]{{8,}}(?=/|$)', '/{{hash}}')"
    staged = staged.withColumn("__path", F.expr(path)).withColumn("__token", F.col("__path"))
    staged = decode_columns(staged, ["__token"], times=2)
    staged = staged.withColumn("__token", F.expr("lower(__token)")).withColumn(
        "__token", F.expr(strip_sql("__token")))
    scanners = quoted("|".join(config.SCANNER_AGENTS))
    masked = mask("__token", config.KEY_BLOB_LENGTH)
    query = f"array_join(transform({query_pairs('__query')}, s -> concat(s.key, '=', s.value)), '&')"
    key = F.expr(
        f"concat(upper(method), ' ', CASE WHEN __path = '/' THEN '/' ELSE {masked} END, '?', "
        f"CASE WHEN __query = '' THEN '' ELSE {query} END, ' ua=', "
        f"CASE WHEN lower(__agent) RLIKE {scanners} THEN 'scanner' ELSE '' END)")
    return with_columns_once(staged, {out: key}).selectExpr(*kept, f"`{out}`")
