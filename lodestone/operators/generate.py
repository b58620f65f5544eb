"""Generators: a protocol, an offline stand-in, and adapters of remote models.

The stand-in rewrites by rule and answers by extraction: the sentence of the
ranked passages that shares most distinct words with the question; ties go to
the better passage, then to the earlier sentence.  Without a shared word it
refuses.  It stands in for a language model's wiring, not for its quality.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import strip
from lodestone.sources.config import Settings, required_env

from .prompts import REFUSAL, SYSTEM_ANSWER, SYSTEM_REWRITE, answer_text, format_context, joined_text_blocks, rewrite_text, system_prompt, turns
from .prompts import messages as message_list

FILLER = "(?i)^\\s*(hello|hi|hey|please|could you|can you|tell me|i would like to know)[,!.:]*\\s+"
LEAST_TEMPERATURE = 1e-5
#: What :func:`strip` takes off; the many sentences of passages lose it without a regular expression.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class Generator(Protocol):
    def rewrite(self, question: Column) -> Column: ...

    def answer(self, question: Column, hits: Column) -> Column: ...


def words(c: Column) -> Column:
    """The words of a text, repeats included."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row; an expression that it names itself is computed wherever it is named, in a lambda each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@dataclass(frozen=True)
class Extractive:
    """The local backend without a model."""

    def rewrite(self, question: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(question, FILLER, ""), r"\s+", " ")
        return F.concat(F.lit('"'), strip(plain), F.lit('"'))

    def answer(self, question: Column, hits: Column) -> Column:
        sentences = lambda h: F.filter(F.transform(F.split(F.coalesce(h.text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.btrim(s, F.lit(WHITE))), lambda s: s != "")
        # an intersection has no repeats
        shared = lambda s, asked: -F.size(F.array_intersect(words(s), asked))
        scored = lambda asked: F.flatten(
            F.transform(hits, lambda h, r: F.transform(sentences(h), lambda s, k: F.struct(shared(s, asked).alias("shared"), r.alias("r"), k.alias("k"), s.alias("s"), F.coalesce(h.source, F.lit("")).alias("source"))))
        )
        said = lambda best: F.when(F.coalesce(best.shared, F.lit(0)) < 0, F.concat(best.s, F.lit(" (Source: "), best.source, F.lit(")"))).otherwise(REFUSAL)
        return let(F.array_distinct(words(question)), lambda asked: let(F.array_min(scored(asked)), said))


Send = Callable[[str, dict[str, str], dict], dict]


def post(url: str, headers: dict[str, str], body: dict) -> dict:
    """The JSON answer to a JSON request."""
    request = urllib.request.Request(url, json.dumps(body).encode(), headers | {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=120) as answer:
        return json.load(answer)


@dataclass(frozen=True)
class Remote:
    """A hosted model, asked from the workers, a message list at a time.

    ``{BACKEND}_API_URL`` and ``{BACKEND}_API_KEY`` of the environment name it,
    on the driver and on the workers; neither is part of a plan.
    """

    backend: str
    model: str
    temperature: float
    max_tokens: int
    send: Send = post

    def __post_init__(self) -> None:
        required_env(self._name("KEY"))

    def _name(self, what: str) -> str:
        return f"{self.backend.upper()}_API_{what}"

    def request(self, messages: Column) -> Column:
        """What the model is asked, beside the settings: the messages as they are."""
        return F.struct(messages.alias("messages"))

    def response(self, answer: Column) -> Column:
        """The text of an answer in JSON."""
        return F.from_json(answer, "choices array<struct<message:struct<content:string>>>").choices[0].message.content

    def headers(self, key: str) -> dict[str, str]:
        return {"Authorization": f"Bearer {key}"}

    def said(self, messages: Column) -> Column:
        """What the model says to each list of ``array<struct<role, content>>``, stripped; the workers send, in Arrow batches."""
        own = self
        settings = {"model": self.model, "temperature": self.temperature, "max_tokens": self.max_tokens}

        @F.pandas_udf("string")
        def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            url, key = required_env(own._name("URL")), required_env(own._name("KEY"))
            for batch in batches:
                yield batch.map(lambda m: json.dumps(own.send(url, own.headers(key), settings | json.loads(m))), na_action="ignore")

        return strip(self.response(ask(F.to_json(self.request(messages)))))

    def rewrite(self, question: Column) -> Column:
        return self.said(message_list(SYSTEM_REWRITE, rewrite_text(F.coalesce(question, F.lit("")), F.lit(None).cast("string"))))

    def answer(self, question: Column, hits: Column) -> Column:
        return self.said(message_list(SYSTEM_ANSWER, answer_text(F.coalesce(question, F.lit("")), format_context(hits))))


@dataclass(frozen=True)
class RemoteBlocks(Remote):
    """A hosted model that takes the system text apart from the turns and answers in blocks."""

    def request(self, messages: Column) -> Column:
        return F.struct(system_prompt(messages).alias("system"), turns(messages).alias("messages"))

    def response(self, answer: Column) -> Column:
        return joined_text_blocks(F.from_json(answer, "content array<struct<type:string,text:string>>").content, "")

    def headers(self, key: str) -> dict[str, str]:
        return {"X-Api-Key": key}


def sampling(temperature: float) -> tuple[float, bool]:
    """The least positive temperature that a sampler takes, and whether to sample at all."""
    return max(temperature, LEAST_TEMPERATURE), temperature > 0


def make_generator(settings: Settings) -> Generator:
    backend = settings.backend.lower()
    if backend == "local":
        return Extractive()
    if backend in ("groq", "api"):
        kind = Remote if backend == "groq" else RemoteBlocks
        return kind(backend, settings.models.get(backend, ""), settings.temperature, settings.max_tokens)
    raise ValueError(f"unknown backend {settings.backend!r}")
