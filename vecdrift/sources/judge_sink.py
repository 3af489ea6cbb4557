"""Asking a paid judge, with every answer kept as it comes.

A sink writes answers from inside the tasks: a task takes its samples a chunk at a
time, asks for a chunk's answers some at once and no faster than its share of the
rate, and puts them into a file of their own under `path`/answers before it goes
on. So a job that is killed, or a task that is run again, has lost a chunk at most.
Samples go to tasks by their id, so that a task that is run again finds the files
of its earlier attempts and asks for the rest only. The driver adds one line for
each run that ended to `path`/runs.

Answers that failed are kept with their error and asked for again by the next run.
`path` is a folder that driver and executors share, in any file system that pyarrow
opens."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.labels import asked, judge_prompt, parse_verdict, prompt_hash
from ..operators.selection import gradable

ANSWERS = "sample_id string, judge_raw_response string, judge_model string, judge_prompt_sha256 string, labelled_at double, error string"
_SCHEMA = pa.schema([("sample_id", pa.string()), ("judge_raw_response", pa.string()), ("judge_model", pa.string()), ("judge_prompt_sha256", pa.string()), ("labelled_at", pa.float64()), ("error", pa.string())])


class Pace:
    """At most `rate` calls a second over all threads of a task; None: no limit."""

    def __init__(self, rate: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep, self.lock, self.next = rate, clock, sleep, Lock(), 0.0

    def wait(self) -> None:
        if self.rate is None:
            return
        with self.lock:
            at = max(self.next, self.clock())
            self.next = at + 1 / self.rate
        if (left := at - self.clock()) > 0:
            self.sleep(left)


@dataclass
class Asked(WriterCommitMessage):
    answered: int
    errors: int
    found: int  # answers of an earlier attempt


@dataclass
class AnswerWriter(DataSourceWriter):
    """Writes answers to rows of sample_id, prompt, hash."""

    judge: Callable[[str], str]
    path: str
    model: str
    concurrency: int
    rate: float | None
    chunk: int
    retries: int
    base_delay: float
    run: str = field(default_factory=lambda: uuid.uuid4().hex)

    def _folder(self, name: str) -> tuple[fs.FileSystem, str]:
        system, at = fs.FileSystem.from_uri(self.path)
        system.create_dir(f"{at}/{name}", recursive=True)
        return system, f"{at}/{name}"

    def _put(self, system: fs.FileSystem, folder: str, name: str, rows: list[dict]) -> None:
        # readers pass over names with a leading underscore
        with system.open_output_stream(f"{folder}/_{name}") as f:
            pq.write_table(pa.Table.from_pylist(rows, _SCHEMA), f)
        system.move(f"{folder}/_{name}", f"{folder}/{name}")

    def write(self, iterator: Iterator) -> Asked:
        task = TaskContext.get()
        system, folder = self._folder("answers")
        own = f"run-{self.run}-{task.partitionId()}-"
        have: set[str] = set()
        for info in system.get_file_info(fs.FileSelector(folder)):
            if info.base_name.startswith(own):
                with system.open_input_file(info.path) as f:
                    have |= set(pq.read_table(f, columns=["sample_id"]).column(0).to_pylist())
        out, pace, held = Asked(0, 0, 0), Pace(self.rate), []
        with ThreadPoolExecutor(self.concurrency) as pool:

            def answer(row) -> dict:
                def once(prompt: str) -> str:
                    pace.wait()
                    return self.judge(prompt)

                raw = error = None
                try:
                    raw = asked(once, row["prompt"], self.retries, self.base_delay)
                except Exception as e:  # noqa: BLE001 one bad row must not end the job
                    error = repr(e)
                return {"sample_id": row["sample_id"], "judge_raw_response": raw, "judge_model": self.model, "judge_prompt_sha256": row["hash"], "labelled_at": time.time(), "error": error}

            def ask() -> None:
                rows = list(pool.map(answer, held))
                self._put(system, folder, f"{own}{task.attemptNumber()}-{uuid.uuid4().hex}.parquet", rows)
                out.errors += sum(r["error"] is not None for r in rows)
                out.answered += sum(r["error"] is None for r in rows)
                held.clear()

            for row in iterator:
                if row["sample_id"] in have:
                    out.found += 1
                    continue
                held.append(row)
                if len(held) >= self.chunk:
                    ask()
            if held:
                ask()
        return out

    def commit(self, messages: list[Asked | None]) -> None:
        system, folder = self._folder("runs")
        done = [m for m in messages if m is not None]
        line = f'{{"run": "{self.run}", "answered": {sum(m.answered for m in done)}, "errors": {sum(m.errors for m in done)}, "found": {sum(m.found for m in done)}, "ended_at": {time.time()}}}\n'
        with system.open_output_stream(f"{folder}/run-{self.run}.json") as f:
            f.write(line.encode())

    def abort(self, messages: list[Asked | None]) -> None:
        """Nothing is taken back: what was answered is paid for."""


def label_durably(samples: DataFrame, judge: Callable[[str], str], path: str, model: str = "judge", tasks: int = 8, concurrency: int = 4, rate: float | None = None, chunk: int = 50, retries: int = 6, base_delay: float = 2.0, limit: int | None = None) -> None:
    """samples: sample_id, question, gold_answers, generated_text, failed. Asks for
    those that read_answers(path) has no answer of: at most `rate` prompts a second
    and tasks * concurrency at once. Null ids and samples that cannot be graded are
    not asked for; of rows with one id, each is asked for once."""
    spark = samples.sparkSession
    todo = gradable(samples).where(F.col("sample_id").isNotNull()).withColumn("sample_id", F.col("sample_id").cast("string"))
    done = read_answers(spark, path)
    if done is not None:
        todo = todo.join(done.where("error is null").select("sample_id"), "sample_id", "left_anti")
    todo = todo.select("sample_id", judge_prompt("question", "generated_text", "gold_answers").alias("prompt"), prompt_hash().alias("hash")).dropDuplicates(["sample_id"])
    if limit is not None:
        todo = todo.orderBy("sample_id").limit(limit)
    writer = AnswerWriter(judge, path, model, concurrency, None if rate is None else rate / tasks, chunk, retries, base_delay)

    class Judge(DataSource):
        @classmethod
        def name(cls) -> str:
            return "judge"

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return writer

    spark.dataSource.register(Judge)
    todo.repartition(tasks, "sample_id").write.format("judge").mode("append").save()


def read_answers(spark: SparkSession, path: str) -> DataFrame | None:
    """ANSWERS and is_hallucination (null if unparseable), one row per sample: its
    first answer, else its last error. None if there are no files yet."""
    system, at = fs.FileSystem.from_uri(path)
    if system.get_file_info(f"{at}/answers").type == fs.FileType.NotFound:
        return None
    rows = spark.read.schema(ANSWERS).parquet(f"{path}/answers")
    good = F.col("error").isNull()
    first = Window.partitionBy("sample_id").orderBy(F.when(good, 0).otherwise(1), F.when(good, F.col("labelled_at")).otherwise(-F.col("labelled_at")))
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return rows.withColumn("is_hallucination", parse_verdict("judge_raw_response"))
