"""The seam of the model: a function from prompt to text, applied to rows, with checked JSON replies."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import regex
from pyspark.sql import DataFrame

TRIES = 3


class Runner(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class Replay:
    """Answers from a function or a dictionary of prompts; for tests and stored runs."""

    def __init__(self, answers: Callable[[str], str] | dict[str, str]) -> None:
        self.answers = answers if callable(answers) else answers.__getitem__

    def complete(self, system: str, user: str) -> str:
        return self.answers(user)


def complete_json(runner: Runner, system: str, user: str, violations: Callable[[dict], list[str]]) -> tuple[dict | None, str | None]:
    """(reply, None), or (None, the last problem) after TRIES; each try is told the first five problems of the one before."""
    prompt, problem = user, None
    for _ in range(TRIES):
        try:
            text = runner.complete(system, prompt)
            found = regex.search(r"\{.*\}", text, flags=regex.S)
            reply = json.loads(found[0]) if found else None
            bad = ["no JSON object"] if not isinstance(reply, dict) else violations(reply)
        except ValueError as e:
            bad = [str(e)]
        except Exception as e:  # noqa: BLE001 a failing runner is a failed row, not a failed job
            return None, f"{type(e).__name__}: {e}"
        if not bad:
            return reply, None
        problem = "; ".join(bad[:5])
        prompt = f"{user}\n\n{problem}"
    return None, problem


def apply_runner(rows: DataFrame, key: str, prompt: str, runner: Runner, system: str, violations: Callable[[dict], list[str]]) -> DataFrame:
    """key, reply (JSON text or null) and problem for each row; the parallelism is the number of partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, p in zip(pdf["k"], pdf["p"], strict=True):
                reply, problem = complete_json(runner, system, p or "", violations)
                out.append((k, None if reply is None else json.dumps(reply, ensure_ascii=False), problem))
            yield pd.DataFrame(out, columns=[key, "reply", "problem"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.selectExpr(f"`{key}` AS k", f"`{prompt}` AS p").mapInPandas(run, f"`{key}` {kind}, reply string, problem string")
