"""The verdict struct: parsing, fallback, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgewatch import config
from hedgewatch.functions.text import strip

VERDICT = T.StructType([
    T.StructField("label", T.IntegerType()),
    T.StructField("attack_type", T.StringType()),
    # text: NULL if missing, 'null' for a JSON null, cast late
    T.StructField("confidence", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("explanation", T.StringType()),
    T.StructField("recommended_actions", T.ArrayType(T.StringType())),
    T.StructField("cve_refs", T.ArrayType(T.StringType())),
    T.StructField("attack_stage", T.StringType()),
    T.StructField("risk_score", T.StringType()),
    T.StructField("ttft_ms", T.DoubleType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("model", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("raw", T.StringType()),
])
_DDL = VERDICT.simpleString()


def strip_fences(raw: Column) -> Column:
    """The answer text without surrounding code fences and whitespace. The opening
    fence is looked for with its language tag first, then plain."""
    text = strip(raw)
    text = F.regexp_replace(text, r"\A```json", "")
    text = F.regexp_replace(text, r"\A```", "")
    return strip(F.regexp_replace(text, r"```\z", ""))


def fallback_verdict(model: Column | None = None, provider: Column | None = None) -> Column:
    null = F.lit(None)
    fields = {
        "label": null, "attack_type": F.lit("unknown"), "confidence": F.lit("0.0"),
        "severity": F.lit("medium"), "explanation": F.lit(config.FALLBACK_EXPLANATION),
        "recommended_actions": F.array(F.lit("monitor")),
        "cve_refs": F.array().cast("array<string>"), "attack_stage": F.lit("unknown"),
        "risk_score": null, "ttft_ms": null, "input_tokens": F.lit(0), "output_tokens": F.lit(0),
        "model": model if model is not None else null,
        "provider": provider if provider is not None else null,
        "latency_ms": null, "raw": null,
    }
    return _struct(fields)


def _struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[
        fields[f.name].cast(f.dataType).alias(f.name) for f in VERDICT.fields
    ]).cast(_DDL)


def parsed_verdict(answer: Column, usage: dict[str, Column] | None = None) -> Column:
    """The verdict of a fence-free answer text (a plain column reference), or the
    fallback where the text is not a JSON object. Numbers of the call itself
    (``usage``: tokens, times, names) come from outside the text."""
    usage = usage or {}
    document = F.try_parse_json(answer)
    is_object = F.startswith(F.coalesce(F.schema_of_variant(document), F.lit("")), F.lit("OBJECT"))

    def get(name: str, kind: str = "string") -> Column:
        return F.try_variant_get(document, f"$.{name}", kind)

    confidence = F.when(
        F.is_variant_null(F.try_variant_get(document, "$.confidence", "variant")), F.lit("null")
    ).otherwise(get("confidence"))
    null = F.lit(None)
    fields = {
        "label": get("label", "int"), "attack_type": get("attack_type"), "confidence": confidence,
        "severity": get("severity"), "explanation": get("explanation"),
        "recommended_actions": get("recommended_actions", "array<string>"),
        "cve_refs": get("cve_refs", "array<string>"), "attack_stage": get("attack_stage"),
        "risk_score": get("risk_score"), "ttft_ms": usage.get("ttft_ms", null),
        "input_tokens": F.coalesce(usage.get("input_tokens", null).cast("bigint"), F.lit(0)),
        "output_tokens": F.coalesce(usage.get("output_tokens", null).cast("bigint"), F.lit(0)),
        "model": usage.get("model", null), "provider": usage.get("provider", null),
        "latency_ms": usage.get("latency_ms", null), "raw": answer,
    }
    return F.when(is_object, _struct(fields)).otherwise(
        fallback_verdict(usage.get("model"), usage.get("provider")))


def confidence_value(confidence: Column) -> Column:
    """Number of the confidence text: missing is 1.0, anything that is not a
    number 0.0."""
    number = F.coalesce(
        confidence.try_cast("double"),
        F.when(F.lower(confidence) == "true", F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.when(confidence.isNull(), F.lit(1.0)).otherwise(number)
