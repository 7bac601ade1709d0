"""Claims from a text model: a hook that a caller gives, called once per part of a package inside the tasks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Predicates that a model fills, with the confidence given to each.
CONFIDENCE = {"purpose": 0.7, "usage_pattern": 0.6, "complexity": 0.6, "stability": 0.5}
#: Symbols named in one prompt; a larger package takes several.
PROMPT_SYMBOLS = 100
CLAIMS = "subject_id long, predicate string, object_text string, confidence double"


def stand_in(system: str, user: str) -> str:
    """A model that repeats what it is asked about: the same reply for the same prompt."""
    names = [line[2:] for line in user.split("\n") if line.startswith("- ")]
    return "```json\n" + json.dumps({n: {p: f"{p} of {n}" for p in CONFIDENCE} for n in names}) + "\n```"


def unfenced(reply: str) -> str:
    """A reply without a code fence around it."""
    body = reply.strip()
    return body.split("\n", 1)[-1].rsplit("```", 1)[0] if body.startswith("```") else body


def parsed(reply: str) -> dict:
    """The object in a reply, with or without a code fence; anything else is empty."""
    try:
        found = json.loads(unfenced(reply))
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def generate(symbols: DataFrame, complete: Callable[[str, str], str]) -> DataFrame:
    """(subject_id, predicate, object_text, confidence) from replies about packages; names and predicates that are not known are dropped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for (package, _), part in frame.groupby(["import_path", "part"]):
                for at in range(0, len(part), PROMPT_SYMBOLS):
                    ids = dict(zip(part["symbol_name"][at : at + PROMPT_SYMBOLS], part["id"][at : at + PROMPT_SYMBOLS]))
                    reply = parsed(complete("Describe each symbol as JSON.", f"Package {package}\n" + "\n".join(f"- {n}" for n in ids)))
                    for name, facts in reply.items():
                        if name in ids and isinstance(facts, dict):
                            rows += [(ids[name], p, str(t), CONFIDENCE[p]) for p, t in facts.items() if p in CONFIDENCE]
            yield pd.DataFrame(rows, columns=["subject_id", "predicate", "object_text", "confidence"])

    # a package's symbols are dealt to as many parts as it takes prompts, so that a large package is many tasks' work
    sizes = symbols.groupBy("import_path").agg(F.ceil(F.count(F.lit(1)) / PROMPT_SYMBOLS).alias("parts"))
    dealt = symbols.select("import_path", "id", "symbol_name").join(sizes, "import_path").withColumn("part", F.pmod(F.xxhash64("symbol_name"), F.col("parts")))
    ordered = dealt.select("import_path", "part", "id", "symbol_name").repartition("import_path", "part").sortWithinPartitions("import_path", "part", "symbol_name", "id")
    return ordered.mapInPandas(run, CLAIMS)
