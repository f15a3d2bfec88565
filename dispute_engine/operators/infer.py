"""Batch inference over a prompt column with a caller-supplied model function.

``mapInPandas`` hands each task Arrow batches; the model function is built
once per task (``fn_factory``) and called on lists of at most ``batch_size``
prompts. NULL prompts are not sent and give a NULL response.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import ensure_table, qualified, stored

ModelFn = Callable[[list[str]], list[str | None]]


def batch_infer(df: DataFrame, prompt_col: str, fn_factory: Callable[[], ModelFn], batch_size: int = 16,
                out_col: str = "llm_response", keep: list[str] | None = None) -> DataFrame:
    """df[keep] + ``out_col`` (string) from ``fn_factory()(prompts)``."""
    keep = list(keep) if keep is not None else [c for c in df.columns]
    src = df.select(*dict.fromkeys(keep + [prompt_col]))
    schema = T.StructType([f for f in src.schema.fields if f.name in keep] + [T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = fn_factory()
        for pdf in batches:
            prompts = pdf[prompt_col]
            out: list[str | None] = [None] * len(pdf)
            idx = [i for i, p in enumerate(prompts) if p is not None and not (isinstance(p, float) and p != p)]
            for start in range(0, len(idx), batch_size):
                chunk = idx[start:start + batch_size]
                for i, r in zip(chunk, fn([prompts.iloc[i] for i in chunk])):
                    out[i] = r
            res = pdf[keep].copy()
            res[out_col] = out
            yield res

    return src.mapInPandas(run, schema)


def prompt_digest(prompt_col: str, model_name: str) -> Column:
    """The address of a response: SHA-256 of the model's name and the prompt."""
    return F.sha2(F.concat_ws("\u0000", F.lit(model_name), F.col(prompt_col)), 256)


RESPONSES = "prompt_digest string, model string, llm_response string"


def respond(df: DataFrame, prompt_col: str, fn_factory: Callable[[], ModelFn], db: str | None, table: str,
            model_name: str, batch_size: int = 16, waves: int = 4, out_col: str = "llm_response",
            keep: list[str] | None = None) -> DataFrame:
    """df[keep] + ``out_col`` through a table of responses addressed by prompt digest.

    Only distinct prompts that the table lacks reach the model. They go in ``waves`` (by digest), each
    appended when it is done, so what was paid for before a failure is kept, and a
    rerun sends the rest alone. NULL prompts are not sent and give a NULL response; a prompt that the model
    answers with NULL counts as answered. The rows are computed once and stored by wave: a wave reads its own part
    alone, and the answers join the stored rows."""
    spark = df.sparkSession
    target = qualified(db, table)
    ensure_table(spark, db, table, T.StructType.fromDDL(RESPONSES))
    keep = list(keep) if keep is not None else list(df.columns)
    asked = df.select(*[df[c] for c in keep], F.when(F.col(prompt_col).isNotNull(), prompt_digest(prompt_col, model_name))
                      .alias("_digest"), F.col(prompt_col).alias("_prompt"))
    wave_of = F.pmod(F.xxhash64("_digest"), F.lit(waves)).cast("int")  # a NULL digest has a hash, but is not sent
    asked = stored(asked.withColumn("_wave", wave_of), "asked", partition_by=["_wave"])
    unseen = asked.where(F.col("_digest").isNotNull()).groupBy("_wave", "_digest").agg(F.first("_prompt").alias("_prompt")) \
                  .join(spark.table(target).select(F.col("prompt_digest").alias("_digest")).hint("merge"), "_digest", "left_anti")
    for wave in range(waves):
        part = unseen.where(F.col("_wave") == wave)
        done = batch_infer(part, "_prompt", fn_factory, batch_size, "llm_response", ["_digest"])
        done.select(F.col("_digest").alias("prompt_digest"), F.lit(model_name).alias("model"), "llm_response") \
            .write.mode("append").insertInto(target)
        spark.catalog.refreshTable(target)
    answers = spark.table(target).select(F.col("prompt_digest").alias("_digest"), F.col("llm_response").alias(out_col))
    # the first append of a digest wins, should two runs have answered it at once
    return asked.drop("_prompt", "_wave").join(answers.groupBy("_digest").agg(F.min(out_col).alias(out_col)).hint("merge"), "_digest", "left") \
                .select(*keep, out_col)


def field_echo_model() -> ModelFn:
    """A pure, deterministic stand-in model: reads the case fields of each
    prompt and answers with the JSON keys the prompt asks for."""
    def fields(prompt: str) -> dict[str, str]:
        out = {}
        for line in prompt.splitlines():
            if line.startswith("- ") and ": " in line:
                k, v = line[2:].split(": ", 1)
                out[k] = v
        return out

    def answer(prompt: str) -> str:
        f = fields(prompt)
        risk = {"P1": "high", "P2": "medium"}.get(f.get("priority", ""), "low")
        missing = [k for k in ("days_to_submit", "timely_flag") if f.get(k) in (None, "")]
        return json.dumps({
            "summary": f"Predicted {f.get('predicted_reason', 'unknown')} at confidence {f.get('confidence', '?')}",
            "rationale": prompt.split("Evidence:\n", 1)[-1].split("\n\nRules:", 1)[0],
            "next_steps": prompt.split("Recommended action:\n", 1)[-1].split("\n\n", 1)[0],
            "missing_info": missing,
            "risk_level": risk,
        }, sort_keys=True)

    return lambda prompts: [answer(p) for p in prompts]
