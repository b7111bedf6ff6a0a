"""Extension points: scanners, rules, report writers, validators, model calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scanloom.operators.scan import scan_rules, scan_secrets
from scanloom.sources.scanners import unify, union_findings

Scanner = Callable[[DataFrame], DataFrame]

BUILT_IN: dict[str, Scanner] = {"secret_scanner": scan_secrets, "config_audit": scan_rules}


class ScannerRegistry:
    """Named scanners, each ``files -> raw findings``; a disabled one never enters the plan."""

    def __init__(self, scanners: dict[str, Scanner] | None = None):
        self._scanners = dict(BUILT_IN if scanners is None else scanners)
        self.failed: dict[str, str] = {}

    def register(self, name: str, scanner: Scanner) -> None:
        self._scanners[name] = scanner

    def run(self, files: DataFrame, *, disabled: tuple[str, ...] = ()) -> DataFrame:
        """All enabled scanners over ``files``, unified.  One that fails to build its plan adds nothing."""
        parts = []
        for name, scanner in self._scanners.items():
            if name in disabled:
                continue
            try:
                parts.append(unify(scanner(files), name))
            except Exception as e:  # a broken plug-in must not stop the others
                self.failed[name] = str(e)
        if not parts:
            raise ValueError("no scanner left to run")
        return union_findings(parts)


def completion_stage(prompts: DataFrame, complete: Callable[[list[str]], list[str]], *, key: str = "id",
                     prompt: str = "prompt", batch: int = 16, concurrency: int | None = None) -> DataFrame:
    """``(key, response)`` from a user-supplied client, called with ``batch`` prompts at a time inside the tasks.

    Partitions follow the data; ``concurrency`` deals the prompts out to that many tasks, for a client with a limit.  A batch
    that fails is asked again prompt by prompt, so one failure costs one answer: a null, which the later join turns into the
    fallback text.
    """
    wanted = prompts.select(key, prompt)
    schema = T.StructType([wanted.schema[key], T.StructField("response", T.StringType())])

    def ask(texts: list[str]) -> list[str | None]:
        try:
            answers = list(complete(texts))
            if len(answers) == len(texts):
                return answers
        except Exception:
            pass
        return [None] if len(texts) == 1 else [a for t in texts for a in ask([t])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = rows[prompt].tolist()
            answers = [a for i in range(0, len(texts), batch) for a in ask(texts[i:i + batch])]
            yield pd.DataFrame({key: rows[key], "response": pd.Series(answers, dtype=object, index=rows.index)})

    return (wanted if concurrency is None else wanted.repartition(concurrency)).mapInPandas(run, schema)
