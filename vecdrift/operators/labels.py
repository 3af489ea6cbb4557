"""Judge prompts and verdicts, agreement with human labels."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import keyed_order
from .selection import gradable

TEMPLATE = "You grade answers.\n\nQuestion:\n{question}\n\nAccepted answers:\n{gold}\n\nAnswer given:\n{answer}\n\nReply with exactly one word: SUPPORTED if the answer agrees with an accepted answer, UNSUPPORTED if it does not."
HUMAN_SUBSET, KAPPA_THRESHOLD = 60, 0.6


def judge_prompt(question: str | Column, answer: str | Column, gold: str | Column, template: str = TEMPLATE) -> Column:
    """The template with the question, the accepted answers as "- " bullets
    and the answer put in."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    bullets = F.array_join(F.transform(c(gold), lambda x: F.concat(F.lit("- "), x)), "\n")
    values = {"question": c(question), "gold": bullets, "answer": c(answer)}
    parts, rest = [], template
    while "{" in rest:
        lead, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(lead), values[name]]
    return F.concat(*parts, F.lit(rest))


def prompt_hash(template: str = TEMPLATE) -> Column:
    return F.sha2(F.lit(template), 256)


def parse_verdict(raw: str | Column) -> Column:
    """1 unsupported, 0 supported, null neither. The longer word is tried
    first, as it contains the other."""
    x = F.upper(F.trim(F.col(raw) if isinstance(raw, str) else raw))
    return F.when(x.contains("UNSUPPORTED"), 1).when(x.contains("SUPPORTED"), 0)


def asked(judge: Callable[[str], str], prompt: str, retries: int = 6, base_delay: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """judge(prompt), tried again after 2 * 2^k * (1 + u) seconds."""
    for k in range(retries):
        try:
            return judge(prompt)
        except Exception:
            if k + 1 == retries:
                raise
            sleep(base_delay * 2**k * (1 + random.random()))
    raise ValueError("retries must be positive")


def label_samples(samples: DataFrame, judge: Callable[[str], str], done: DataFrame | None = None, model: str = "judge", retries: int = 6, base_delay: float = 2.0, limit: int | None = None) -> DataFrame:
    """samples: sample_id, question, gold_answers, generated_text, failed. Rows
    for those not done yet: sample_id, is_hallucination (null if unparseable),
    judge_raw_response, judge_model, judge_prompt_sha256, labelled_at, error. A
    judge that fails on a row leaves its error there and the rest go on."""
    todo = samples if done is None else samples.join(done.select("sample_id").distinct(), "sample_id", "left_anti")
    if limit is not None:
        todo = todo.orderBy("sample_id").limit(limit)
    todo = gradable(todo).select("sample_id", judge_prompt("question", "generated_text", "gold_answers").alias("prompt"))

    def run(batches):
        for pdf in batches:
            raw, error, at = [], [], []
            for prompt in pdf["prompt"]:
                try:
                    raw.append(asked(judge, prompt, retries, base_delay))
                    error.append(None)
                except Exception as e:  # noqa: BLE001 one bad row must not end the job
                    raw.append(None)
                    error.append(repr(e))
                at.append(time.time())
            yield pd.DataFrame({"sample_id": pdf["sample_id"], "judge_raw_response": raw, "error": error, "labelled_at": at})

    id_type = samples.schema["sample_id"].dataType.simpleString()
    rows = todo.mapInPandas(run, f"sample_id {id_type}, judge_raw_response string, error string, labelled_at double")
    return rows.select("sample_id", parse_verdict("judge_raw_response").alias("is_hallucination"), "judge_raw_response", F.lit(model).alias("judge_model"), prompt_hash().alias("judge_prompt_sha256"), "labelled_at", "error")


def label_counts(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """labelled (unparseable ones too), skipped_failed, unparseable, errors."""
    bad = samples.join(gradable(samples).select("sample_id"), "sample_id", "left_anti").agg(F.count("*").alias("skipped_failed"))
    got = labels.agg(F.count_if(F.col("error").isNull()).alias("labelled"), F.count_if(F.col("error").isNull() & F.col("is_hallucination").isNull()).alias("unparseable"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    return got.crossJoin(bad).select("labelled", "skipped_failed", "unparseable", "errors")


def human_subset(labels: DataFrame, n: int = HUMAN_SUBSET, seed: int = 42) -> DataFrame:
    """n labelled ids with an empty human_label, sorted."""
    ids = labels.where(F.col("is_hallucination").isNotNull()).select("sample_id")
    return ids.orderBy(keyed_order(seed, "sample_id"), "sample_id").limit(n).orderBy("sample_id").withColumn("human_label", F.lit(""))


def kappa(pairs: DataFrame, a: str = "judge", b: str = "human", threshold: float = KAPPA_THRESHOLD) -> DataFrame:
    """One row: n, agreement, kappa (null if chance agreement is 1), reliable.
    Raises with fewer than two pairs."""
    pairs = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    p = lambda x: F.avg((F.col(x) == 1).cast("double"))
    row = pairs.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"), p(a).alias("_a"), p(b).alias("_b"))
    if (row.first()["n"] or 0) < 2:
        raise ValueError("kappa needs at least two pairs")
    pe = F.col("_a") * F.col("_b") + (1 - F.col("_a")) * (1 - F.col("_b"))
    k = F.try_divide(F.col("agreement") - pe, 1 - pe)
    return row.select("n", "agreement", k.alias("kappa"), (k >= threshold).alias("reliable"))


def judge_human_kappa(labels: DataFrame, human: DataFrame) -> DataFrame:
    """labels: sample_id, is_hallucination; human: sample_id, human_label."""
    pairs = labels.join(human, "sample_id").select(F.col("is_hallucination").alias("judge"), F.col("human_label").alias("human"))
    return kappa(pairs)


def label_distribution(labels: DataFrame, label: str = "is_hallucination") -> DataFrame:
    """label, n, share."""
    rows = labels.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("_all"))
    return rows.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("_all")).alias("share"))
