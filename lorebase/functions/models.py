"""Deterministic stand-ins for the external model ports.

Real models are remote services. A port is a factory of Arrow-batched functions:
``embed(texts)``, ``map_text(texts, budgets)`` and ``reduce_text(texts, budgets)``.
The stand-ins below read the whole text and need no network; they make no claim of
semantic quality. A null answer means the call failed for that row.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.functions.arrow import arrow_function

EMBEDDING_SIZE = 64


@lru_cache(maxsize=200_000)
def _token_slot(token: str) -> int:
    return hashlib.md5(token.encode("utf-8")).digest()[0] % EMBEDDING_SIZE


def token_counts(text: str) -> np.ndarray:
    tokens = text.lower().split()
    slots = np.fromiter(map(_token_slot, tokens), dtype=np.intp, count=len(tokens))
    return np.bincount(slots, minlength=EMBEDDING_SIZE).astype(np.float32)


@arrow_function(T.ArrayType(T.FloatType()))
def hashed_embedding(texts: pd.Series) -> pd.Series:
    """Feature hashing: token counts in 64 slots chosen by MD5."""
    return texts.map(token_counts, na_action="ignore")


def digest(text: str, budget: int) -> str:
    """The most frequent words of the whole text that fit the budget, in first-seen order.

    A text within the budget is kept as it is.
    """
    if len(text) <= budget:
        return text
    first: dict[str, int] = {}
    times: Counter[str] = Counter()
    for position, word in enumerate(text.split()):
        first.setdefault(word, position)
        times[word] += 1
    used, kept = 0, []
    for word in sorted(first, key=lambda w: (-times[w], first[w])):
        used += len(word) + 1
        if used > budget + 1:
            break
        kept.append(word)
    return " ".join(sorted(kept, key=first.__getitem__))


@arrow_function(T.StringType())
def digest_text(texts: pd.Series, budgets: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else digest(t, int(b)) for t, b in zip(texts, budgets)], dtype="object")


@arrow_function(T.StringType())
def echo_answer(prompts: pd.Series) -> pd.Series:
    """Answer port: a JSON object with the prompt, in the form that a chat model would be asked for."""
    import json

    return prompts.map(lambda p: json.dumps({"answer": p}, ensure_ascii=False), na_action="ignore")


@arrow_function(T.StringType())
def condensed_question(prompts: pd.Series) -> pd.Series:
    """Condense port: the prompt as it is."""
    return prompts


@dataclass(frozen=True)
class ModelPorts:
    """The model calls that a job uses; every member is a column function."""

    embed: Any = field(default=hashed_embedding)
    map_text: Any = field(default=digest_text)
    reduce_text: Any = field(default=digest_text)
    answer: Any = field(default=echo_answer)
    condense: Any = field(default=condensed_question)



def with_retries(
    call, attempts: int, base_seconds: float, sleep, final: tuple[type[Exception], ...] = (TimeoutError, ConnectionError, OSError)
) -> Any:
    """Call again after 1x, 2x, 4x ... the base delay; ``final`` errors are not retried.

    The default is the rule of model calls, where time-outs and lost connections are final.
    """
    for attempt in range(attempts):
        try:
            return call()
        except final:
            raise
        except Exception:
            if attempt == attempts - 1:
                raise
            sleep(base_seconds * 2**attempt)
    raise RuntimeError("no attempts allowed")
