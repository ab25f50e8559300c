"""A hook for model runtimes: prompts in, outputs out; everything downstream is plain DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def generate(prompts: DataFrame, generator: Callable[[list[str]], list[str]], batch: int = 16) -> DataFrame:
    """(id, output) of generator(list of prompts) for each row of id, prompt.

    Longest prompts come first, over all partitions, so that a batch holds prompts of like length and one that doesn't
    fit into memory fails early. Null prompts are empty; an empty table gives no rows.
    """
    kind = prompts.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                out = generator(part["prompt"].tolist())
                if len(out) != len(part):
                    raise ValueError(f"{len(part)} prompts gave {len(out)} outputs")
                yield pd.DataFrame({"id": part["id"].to_numpy(), "output": out})

    rows = prompts.select("id", F.coalesce("prompt", F.lit("")).alias("prompt"))
    order = [F.desc(F.length("prompt")), F.col("id")]
    parts = int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(run, f"id {kind}, output string")


def request_issues(max_tokens: Column, turns: Column) -> Column:
    """What is wrong with a request, in order: max_tokens outside of 1 to 1024, or a last turn that isn't the user's."""
    last = F.try_element_at(turns, F.lit(-1))["role"]
    found = {"max_tokens": ~F.coalesce(max_tokens.between(1, 1024), F.lit(False)), "last_turn_not_user": F.coalesce(last != "user", F.lit(True))}
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()]))
