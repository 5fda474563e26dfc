"""Model calls as a batched stage, with parsing of what models answer."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[str]]


def dry_run(prompts: list[str]) -> list[str]:
    """A deterministic provider for tests and rehearsals: answers the first option letter of the prompt."""
    return [json.dumps({"answer": (re.findall(r"(?<![A-Za-z])[A-D](?![A-Za-z])", p) or [""])[0], "confidence": 0.0}) for p in prompts]


def call_model(prompts: DataFrame, provider: Provider = dry_run, batch: int = 32) -> DataFrame:
    """(key, output, prompt_tokens, completion_tokens): ``provider`` called on batches of prompts where the rows are.

    Tokens are estimated as half of the characters. The provider is called at least once per row (a lost executor repeats its
    partition), so one that costs money should remember keys.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                outputs = provider([p or "" for p in part["prompt"]])
                yield pd.DataFrame({"key": part["key"].to_numpy(), "output": outputs, "prompt_tokens": [len(p or "") // 2 for p in part["prompt"]], "completion_tokens": [len(o) // 2 for o in outputs]})

    return prompts.select("key", "prompt").mapInPandas(run, "key string, output string, prompt_tokens long, completion_tokens long")


def evidence_listing(items: Column) -> Column:
    """Numbered evidence lines of an array of texts."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("[E"), F.lpad((i + 1).cast("string"), 3, "0"), F.lit("] "), x)), "\n")


def json_of(text: Column) -> Column:
    """The JSON object in a model's output: fenced, bare, or within other text."""
    return F.nullif(F.regexp_extract(text, "(?s)(\\{.*\\})", 1), F.lit(""))


def parse_answer(text: Column, answer_format: Column) -> Column:
    """Letters of the answer: the JSON field, else a labelled one, else letters that stand alone; multi sorted and distinct, else the first."""
    labelled = F.regexp_extract(text, "(?i)(?:answer|答案|选择)\\s*[:：是为]?\\s*([A-D](?:[,、\\s]*[A-D])*)(?![A-Za-z])", 1)
    alone = F.array_join(F.regexp_extract_all(text, F.lit("(?<![A-Za-z])([A-D])(?![A-Za-z])"), 1), "")
    found = F.upper(F.coalesce(F.nullif(F.get_json_object(json_of(text), "$.answer"), F.lit("")), F.nullif(labelled, F.lit("")), alone))
    letters = F.regexp_extract_all(found, F.lit("([A-D])"), 1)
    return F.when(answer_format == "multi", F.array_join(F.array_sort(F.array_distinct(letters)), "")).otherwise(F.coalesce(F.get(letters, F.lit(0)), F.lit("")))


def parse_verdict(text: Column) -> Column:
    """true, false or null from a model's output; a negative word wins over a positive one."""
    value = F.lower(F.coalesce(F.get_json_object(json_of(text), "$.verdict"), F.get_json_object(json_of(text), "$.truth"), text))
    return F.when(value.rlike("\\bfalse\\b|不成立|不正确|错误|不支持"), False).when(value.rlike("\\btrue\\b|成立|正确|支持"), True)


def confidence(text: Column) -> Column:
    number = F.coalesce(F.get_json_object(json_of(text), "$.confidence"), F.nullif(F.regexp_extract(text, "(?:confidence|置信度)\\D{0,3}([0-9.]+)", 1), F.lit(""))).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0))))
