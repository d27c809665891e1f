"""Verdict requests, inference through a user-supplied callable, parsing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgewatch import config
from hedgewatch.functions.once import with_columns_once
from hedgewatch.functions.text import decode_columns, list_literal, non_empty
from hedgewatch.functions.verdict import parsed_verdict, strip_fences
from hedgewatch.operators.answer_journal import PartitionJournal, digest, with_known_answers

# ``provider()`` is called once per partition and gives a function from a list
# of request texts to as many answers. An answer is a text, None (failed), or a
# dict with ``text`` and any of the usage fields.
Provider = Callable[[], Callable[[list[str]], list]]

USAGE = {"input_tokens": "bigint", "output_tokens": "bigint", "ttft_ms": "double",
         "model": "string", "provider": "string", "latency_ms": "double"}
ANSWER = "request string, raw string, " + ", ".join(f"{n} {t}" for n, t in USAGE.items())


@dataclass(frozen=True)
class Lengths:
    """How much of an event a request text holds; None for all of it."""
    text: int | None = None
    agent: int | None = None
    rules: int | None = None


WHOLE = Lengths()
#: For providers whose requests must stay short.
SHORT = Lengths(config.SUMMARY_CHARS, config.SUMMARY_AGENT_CHARS, config.SUMMARY_RULES)


def with_event_summary(df: DataFrame, out: str = "event_summary", lengths: Lengths = WHOLE) -> DataFrame:
    """Newline-joined ``name=value`` evidence of one event."""
    kept = [c for c in df.columns if c != out]
    staged = decode_columns(df.withColumns({
        "__path": F.coalesce("path", F.lit("")), "__query": F.coalesce("query_string", F.lit("")),
        "__agent": F.coalesce("user_agent", F.lit("")),
    }), ["__path", "__query", "__agent"], times=2)

    def short(name: str, limit: int | None) -> Column:
        whole = F.regexp_replace(name, r"[\n\r]", " ")
        return whole if limit is None else F.left(whole, F.lit(limit))

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}="), value)

    def joined(items: Column) -> Column:
        return non_empty(F.array_join(items, ","))

    def score(name: str) -> Column:
        # rounds the binary value, as the reader of the request expects
        return F.format_number(name, 3)

    summary = F.concat_ws(
        "\n",
        line("method", F.col("method")),
        line("path", short("__path", lengths.text)),
        line("status", F.col("status_code").cast("string")),
        line("merged_score", score("merged_score")),
        line("rule_score", score("rule_score")),
        line("ml_score", score("ml_score")),
        line("query", non_empty(short("__query", lengths.text))),
        line("user_agent", non_empty(short("__agent", lengths.agent))),
        line("rule_attack_types", joined(F.col("attack_types"))),
        line("matched_rules", joined(F.col("matched_rules") if lengths.rules is None else F.slice("matched_rules", 1, lengths.rules))),
    )
    return staged.withColumn(out, summary).select(*kept, out)


def context_summary() -> Column:
    """Fixed-order context lines of one event."""
    types = F.coalesce(non_empty(F.array_join("attack_types", ",")), F.lit("none"))
    return F.concat_ws(
        "\n",
        F.lit("pipeline_scope=single_request_content_only"),
        F.lit("behavior_detection=disabled"),
        F.concat(F.lit("source="), F.col("source")),
        F.concat(F.lit("rule_attack_types="), types),
        F.concat(F.lit("matched_rule_count="), F.size("matched_rules").cast("string")),
    )


def with_request(df: DataFrame, lengths: Lengths = WHOLE) -> DataFrame:
    """Add ``event_summary``, ``context_summary`` and the ``request`` text."""
    rules = F.when(F.size("matched_rules") > 0, F.concat(
        F.lit("\n\nMatched Local Rules:\n"), list_literal(F.col("matched_rules")))
    ).otherwise(F.lit(""))
    return with_event_summary(df, lengths=lengths).withColumn("context_summary", context_summary()).withColumn(
        "request", F.concat(F.lit("Event:\n"), F.col("event_summary"), F.lit("\n\nContext:\n"),
                            F.col("context_summary"), rules))


def infer_verdicts(requests: DataFrame, provider: Provider, at_once: int = 16, journal: str | None = None) -> DataFrame:
    """One answer per row of ``requests(request, ...)``, columns kept.

    Calls have side effects and a retried task repeats them, so callers write or
    checkpoint the result before they use it. Requests are sent in groups of
    ``at_once``; a group that raises, or gets another number of answers, is sent again one by
    one, so only the requests that fail have no answer. ``error`` tells why, also
    where the provider could not be made (it is tried again with the next Arrow batch).

    With a ``journal`` (a shared folder that executors can open) answers are appended there group by group, so a retried task, or
    another run with the same journal, asks only for what is missing. Failed requests are not written and are asked again. Two
    attempts of a task at the same time may both ask.
    """
    fields = list(USAGE)
    kept = [f for f in requests.schema.fields if f.name not in ("raw", "error", *fields)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
                       + ["raw string", "error string"] + [f"{n} {t}" for n, t in USAGE.items()])
    names = [f.name for f in kept]
    folder = f"{journal}/run={uuid.uuid4()}" if journal else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = None
        written = PartitionJournal(f"{folder}/part={TaskContext.get().partitionId()}") if folder else None
        for batch in batches:
            texts = batch["request"].tolist()
            answers: list[dict | None] = [None] * len(texts)
            if written:
                answers = [json.loads(k) if isinstance(k, str) else written.known.get(digest(t)) for t, k in zip(texts, batch["__known"])]
            open_ = [i for i, a in enumerate(answers) if a is None]
            try:
                complete = complete or (provider() if open_ else None)
            except Exception as failure:  # told in ``error``, like a failed request
                reason = f"no provider: {type(failure).__name__}: {failure}"
            for start in range(0, len(open_), at_once):
                group = open_[start:start + at_once]
                fresh = [{"error": reason}] * len(group) if complete is None else _answers(complete, [texts[i] for i in group])
                for i, answer in zip(group, fresh):
                    answers[i] = answer
                if written:
                    written.append({digest(texts[i]): _plain(a) for i, a in zip(group, fresh) if not a.get("error") and a.get("text") is not None})
            out = batch[names].copy()
            out["raw"] = [a.get("text") for a in answers]
            out["error"] = pd.Series([a.get("error") for a in answers], index=out.index, dtype=object)
            for field in fields:
                out[field] = pd.Series([a.get(field) for a in answers], index=out.index,
                                       dtype=object)
            yield out

    return (with_known_answers(requests, journal, "__known") if journal else requests).mapInPandas(run, schema)


def _plain(answer: dict) -> dict:
    """What a journal keeps of an answer: its text and usage, numbers as plain ones."""
    return {k: v.item() if hasattr(v, "item") else v for k, v in answer.items() if k == "text" or k in USAGE}


def _answers(complete: Callable[[list[str]], list], texts: list[str]) -> list[dict]:
    """As many answers as texts; one that failed has ``error`` and no text."""
    try:
        answers = list(complete(texts))
        if len(answers) != len(texts):
            raise ValueError(f"{len(answers)} answers to {len(texts)} requests")
    except Exception as failure:  # whatever the provider raises, the job goes on
        if len(texts) == 1:
            return [{"error": f"{type(failure).__name__}: {failure}"}]
        return [a for text in texts for a in _answers(complete, [text])]
    return [a if isinstance(a, dict) else {"text": a} for a in answers]


def parse_verdict(answers: DataFrame, out: str = "verdict") -> DataFrame:
    """``raw`` answers to the verdict struct; the fallback where there is none."""
    usage = {n: F.col(n) for n in USAGE if n in answers.columns}
    kept = [c for c in answers.columns if c not in ("raw", "error", out, *usage)]
    staged = answers.withColumn("__answer", strip_fences(F.coalesce("raw", F.lit(""))))
    return with_columns_once(staged, {out: parsed_verdict(F.col("__answer"), usage)}).select(*kept, out)
