"""Provider contracts: models stay outside; these are the shapes that they plug into, with deterministic stand-ins.

A provider is a function over batches for mapInPandas, so a model is loaded once in a worker and sees rows in batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from storyloom.sources.wav import RATE, wrap_pcm

Provider = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def analyse(prompts: DataFrame, provider: Provider, key: str = "chunk_id") -> DataFrame:
    """(key, raw): one reply for each prompt."""
    return prompts.mapInPandas(provider, f"{key} {dict(prompts.dtypes)[key]}, raw string")


def in_turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stand-in for the analysis of a chapter: two speakers say the lines of dialogue in turn. Blank or null prompts have none."""
    for batch in batches:
        key, out = batch.columns[0], []
        for prompt in batch["prompt"]:
            said = [int(m[1]) for m in re.finditer(r"(?m)^\[(\d+)\]\[DIALOGUE\] ", prompt or "")]
            speakers = ["One", "Other"]
            found = [{"index": i, "character_name": speakers[k % 2]} for k, i in enumerate(said)]
            out.append(json.dumps({"characters": [{"name": n} for n in speakers[: len(said)]], "attributions": found}))
        yield pd.DataFrame({key: batch[key], "raw": out})


def same_trait(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stand-in for merge suggestions: a name is that of the first in the list whose first trait is the same; names without traits
    are nobody else's."""
    for batch in batches:
        key, out = batch.columns[0], []
        for prompt in batch["prompt"]:
            first: dict[str, str] = {}
            found = []
            for line in prompt.split("\n")[1:]:
                name, *traits = line.split(" | ")
                if traits and first.setdefault(traits[0], name) != name:
                    found.append({"survivor_name": first[traits[0]], "merged_name": name, "reason": traits[0]})
            out.append(json.dumps({"merges": found}))
        yield pd.DataFrame({key: batch[key], "raw": out})


def synthesise(lines: DataFrame, provider: Provider) -> DataFrame:
    """(segment_id, audio): one WAV for each (segment_id, text, voice_id), in the order of the lines."""
    return lines.mapInPandas(provider, f"segment_id {dict(lines.dtypes)['segment_id']}, audio binary")


def silence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stand-in for speech: 10 ms of silence for each code point. A null text gives no audio."""
    for batch in batches:
        yield pd.DataFrame({"segment_id": batch["segment_id"], "audio": [None if t is None else wrap_pcm(bytes(2 * (RATE * len(t) // 100))) for t in batch["text"]]})


def echo(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stand-in for speech whose samples tell the text: its UTF-8 bytes, even in number by a blank, at 1000 frames a second. A null text gives no audio."""
    for batch in batches:
        bodies = [None if t is None else t.encode() for t in batch["text"]]
        yield pd.DataFrame({"segment_id": batch["segment_id"], "audio": [None if b is None else wrap_pcm(b + b" " * (len(b) % 2), 1000) for b in bodies]})


def with_retries(call: Callable[[str], str], tries: int = 3, wait: float = 0.0) -> Callable[[str], str]:
    """Call again after a failure, but not after the last try."""
    import time

    def run(text: str) -> str:
        for n in range(tries):
            try:
                return call(text)
            except Exception:
                if n + 1 == tries:
                    raise
                time.sleep(wait)
        raise AssertionError

    return run
