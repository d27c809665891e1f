"""Rule tables: the built-in rules, rule JSON and rule configuration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgewatch import config
from hedgewatch.functions.literals import required_literals
from hedgewatch.sources.files import exists

RULE_SCHEMA = ("ordinal int, name string, score double, pattern string, field string, "
               "attack_type string, source string, needles array<string>")
RAW_SCHEMA = "id bigint, regex string, attack_type string, target string"

# Regular expression flags. Text matches by Unicode rules, and only a newline
# ends a line.
CASELESS, CASED = "(?iUd)", "(?Ud)"

# Fixed value: shape of one directive in a rule configuration file.
_DIRECTIVE = (r'(?sUd)SecRule\s+(\S+)\s+"@rx\s+(.+?)"\s*(?:\\\s*)?"([^"]+)"')


RULE_COLUMNS = [c.split()[0] for c in RULE_SCHEMA.split(", ")]
BUILTIN = [
    (i, name, score, (CASELESS if caseless else CASED) + pattern, field, kind, "custom",
     list(config.RULE_NEEDLES.get(name, ())) or None)
    for i, (name, score, field, kind, caseless, pattern) in enumerate(config.BUILTIN_RULES)
]


def builtin_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUILTIN, RULE_SCHEMA)


def read_rule_conf(spark: SparkSession, path: str) -> DataFrame:
    """``(id, regex, attack_type, target)`` from rule configuration files."""
    text = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return compilable(parse_rule_conf(text), "regex").select("id", "regex", "attack_type", "target")


def parse_rule_conf(files: DataFrame) -> DataFrame:
    """Directives in ``text``, in file order; ``files`` has ``file`` and ``text``.
    Directives without an id or with an id outside the known ranges are dropped."""
    text = F.make_valid_utf8("text")
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(_DIRECTIVE), F.lit(1)).alias("target"),
        F.regexp_extract_all(text, F.lit(_DIRECTIVE), F.lit(2)).alias("regex"),
        F.regexp_extract_all(text, F.lit(_DIRECTIVE), F.lit(3)).alias("options"),
    )
    directives = files.select("file", F.posexplode(found).alias("position", "d")).select(
        "file", "position",
        F.regexp_extract("d.options", r"id:(\d+)", 1).try_cast("bigint").alias("id"),
        F.col("d.regex").alias("regex"), F.col("d.target").alias("target"))
    return directives.withColumn("attack_type", _type_of_id(F.col("id"))).filter(
        F.col("attack_type").isNotNull())


def _type_of_id(rule_id: Column) -> Column:
    out = None
    for low, high, kind in config.IMPORTED_ID_RANGES:
        inside = rule_id.between(low, high)
        out = F.when(inside, kind) if out is None else out.when(inside, kind)
    return out


def read_rule_json(spark: SparkSession, path: str) -> DataFrame:
    """Rule JSON (one array of objects), empty if there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], RAW_SCHEMA)
    return spark.read.schema(RAW_SCHEMA).json(path, multiLine=True)


def usable_field(target: Column) -> Column:
    """The event field a rule target applies to, NULL if there is none. ``!`` is
    deleted first, so an exclusion counts as an inclusion."""
    parts = F.split(F.replace(F.coalesce(target, F.lit("")), F.lit("!")), r"\|")

    def any_of(names: tuple[str, ...]) -> Column:
        return F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))

    return F.when(any_of(config.IMPORTED_REQUEST_TARGETS), "any").when(
        any_of(config.IMPORTED_AGENT_TARGETS), "user_agent")


def imported_rules(raw: DataFrame) -> DataFrame:
    """Rules from raw ``(id, regex, attack_type, target)`` rows, without those for
    fields a log does not have and those known to match anything."""
    regex = F.coalesce("regex", F.lit(""))
    return raw.withColumns({"field": usable_field(F.col("target")), "regex": regex}).filter(
        F.col("field").isNotNull()
        & ~F.col("regex").isin(*config.IMPORTED_MATCH_ALL)
        & ~F.coalesce(F.col("id"), F.lit(0)).isin(*config.IMPORTED_SKIPPED_IDS)
    ).select(
        F.col("id"),
        F.concat(F.lit("crs_"), F.col("id").cast("string")).alias("name"),
        F.lit(config.IMPORTED_RULE_SCORE).alias("score"),
        F.concat(F.lit(CASELESS), F.col("regex")).alias("pattern"),
        "field", "attack_type", F.lit("crs").alias("source"))


def compilable(rules: DataFrame, pattern: str) -> DataFrame:
    """Rules whose pattern compiles. The table is configuration, so its patterns
    are checked on the driver with the engine that will run them."""
    spark = rules.sparkSession
    compiler = spark.sparkContext._jvm.java.util.regex.Pattern
    kept = []
    for row in rules.collect():
        try:
            compiler.compile(row[pattern])
        except Exception:  # the engine's own syntax error
            continue
        kept.append(row)
    return spark.createDataFrame(kept, rules.schema)


def load_rules(spark: SparkSession, json_path: str | None = None) -> DataFrame:
    """Built-in rules first, then the imported ones, with a running ordinal and the texts their patterns cannot match without."""
    return builtin_rules(spark) if json_path is None else with_imported(spark, read_rule_json(spark, json_path))


def with_imported(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """The same from raw ``(id, regex, attack_type, target)`` rows."""
    listed = compilable(imported_rules(raw), "pattern").collect()
    start = len(config.BUILTIN_RULES)
    rows = [(start + i, r["name"], r["score"], r["pattern"], r["field"], r["attack_type"],
             r["source"], required_literals(r["pattern"])) for i, r in enumerate(listed)]
    return builtin_rules(spark).unionByName(spark.createDataFrame(rows, RULE_SCHEMA))
