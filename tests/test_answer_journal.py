import collections
import json
import os

import pytest
from pyspark.sql import functions as F

from hedgewatch.operators import verdicts
from hedgewatch.operators.answer_journal import PartitionJournal


def requests(spark, n=200):
    return spark.range(0, n, 1, 4).select("id", F.concat(F.lit("request é "), F.col("id")).alias("request"))


def telling(log, dies_at=None):
    """A provider that notes each request in a file; its process ends before it answers the request ``dies_at``."""
    def provider():
        def complete(texts):
            if dies_at is not None and dies_at in texts:
                os._exit(1)
            with open(log, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return [{"text": t.upper(), "input_tokens": len(t), "model": "m"} for t in texts]
        return complete
    return provider


def asked(log):
    return collections.Counter(log.read_text().splitlines()) if log.exists() else collections.Counter()


def test_a_killed_task_asks_once_for_each_request(spark, tmp_path):
    log, journal = tmp_path / "log", str(tmp_path / "journal")
    with pytest.raises(Exception):
        verdicts.infer_verdicts(requests(spark), telling(log, "request é 30"), 5, journal).collect()
    before = asked(log)
    assert 30 <= sum(before.values()) < 200 and "request é 29" in before
    rows = verdicts.infer_verdicts(requests(spark), telling(log), 5, journal).collect()
    assert sorted(r["id"] for r in rows) == list(range(200))
    assert all(r["raw"] == f"REQUEST É {r['id']}" and r["input_tokens"] == len(r["request"]) and r["error"] is None for r in rows)
    # groups of the other tasks may have been under way when the job was ended; what was answered is not asked again
    again = {t for t, n in asked(log).items() if n > 1}
    assert len(again) <= 4 * 5 and not again & {f"request é {i}" for i in range(25)}
    # a third run asks for nothing, even of rows partitioned otherwise
    total = sum(asked(log).values())
    third = verdicts.infer_verdicts(requests(spark).repartition(7), telling(log), 5, journal).collect()
    assert len(third) == 200 and sum(asked(log).values()) == total
    assert {r["model"] for r in third} == {"m"}


def test_a_later_attempt_reads_its_own_partition(tmp_path):
    folder = str(tmp_path / "part=0")
    first = PartitionJournal(folder)
    first.append({"a": {"text": "x\ny"}, "b": {"text": "é", "input_tokens": 3}})
    first.append({})
    (tmp_path / "part=0" / "_unfinished.json").write_text("{")
    assert PartitionJournal(folder).known == {"a": {"text": "x\ny"}, "b": {"text": "é", "input_tokens": 3}}
    assert len([n for n in os.listdir(folder) if not n.startswith("_")]) == 1


def test_failures_are_asked_again(spark, tmp_path):
    log, journal = tmp_path / "log", str(tmp_path / "journal")

    def failing():
        def complete(texts):
            if any(t.endswith("7") for t in texts):
                raise RuntimeError("busy")
            return [json.dumps({"attack_type": "xss"})] * len(texts)
        return complete
    first = verdicts.infer_verdicts(requests(spark, 40), failing, 4, journal).collect()
    assert sum(r["error"] is not None for r in first) == 4
    second = verdicts.infer_verdicts(requests(spark, 40), telling(log), 4, journal).collect()
    assert set(asked(log)) == {f"request é {i}" for i in (7, 17, 27, 37)}
    assert all(r["error"] is None for r in second)
    assert verdicts.infer_verdicts(requests(spark, 0), telling(log), 4, journal).collect() == []
