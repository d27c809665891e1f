"""A journal of answers: what a provider has answered is not asked again when a task or a whole run is repeated.

A task appends the answers of each group of requests, under a digest of the request, before it sends the next group. A later attempt
of the task reads what its partition has written; a later run joins the whole journal to its requests.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgewatch.sources.files import listing

ROW = "key string, answer string"


def digest(request: str) -> str:
    return hashlib.sha256(request.encode("utf-8", "surrogatepass")).hexdigest()


def with_known_answers(requests: DataFrame, journal: str, out: str) -> DataFrame:
    """Add the answers that earlier runs have written, NULL where there is none."""
    spark = requests.sparkSession
    if not listing(spark, journal):
        return requests.withColumn(out, F.lit(None).cast("string"))
    known = spark.read.schema(ROW).option("recursiveFileLookup", True).json(journal).groupBy("key").agg(F.min("answer").alias(out))
    # requests of the same text may be many: the optimizer splits such a key's side of the join
    return requests.withColumn("__key", F.sha2("request", 256)).join(known.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")


class PartitionJournal:
    """The answers of one partition of one run, as a task writes and reads them."""

    def __init__(self, folder: str):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.known: dict[str, dict] = {}
        for found in self.files.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if not found.base_name.startswith("_"):
                with self.files.open_input_stream(found.path) as stream:
                    for line in stream.read().decode().splitlines():
                        row = json.loads(line)
                        self.known[row["key"]] = json.loads(row["answer"])
        self.files.create_dir(self.folder, recursive=True)

    def append(self, answers: dict[str, dict]) -> None:
        """A file that is there whole or not at all."""
        if not answers:
            return
        name = f"{uuid.uuid4()}.json"
        lines = (json.dumps({"key": k, "answer": json.dumps(a, sort_keys=True)}) for k, a in answers.items())
        with self.files.open_output_stream(f"{self.folder}/_{name}") as stream:
            stream.write("".join(f"{line}\n" for line in lines).encode())
        self.files.move(f"{self.folder}/_{name}", f"{self.folder}/{name}")
        self.known |= answers
