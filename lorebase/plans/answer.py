"""Answering questions over the store: expert, guidance and generic handlers.

All questions of a batch are answered together; every handler returns one response row
per question.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase import fixed
from lorebase.functions import messages
from lorebase.functions.answers import answer_text
from lorebase.functions.models import ModelPorts
from lorebase.functions.text import render, strip_citations
from lorebase.functions.urls import question_collection
from lorebase.operators.retrieval import (
    contexts, expert_results, first_per_source, guidance_results,
)
from lorebase.plans.graph import PromptGraph
from lorebase.sources.store import KnowledgeStore

SOURCE = (
    "struct<chunkIndex: int, embeddingType: string, documentId: string, source: string, title: string, "
    "type: string, score: double, uri: string>"
)


def history_text(history: Column) -> Column:
    lines = F.transform(history, lambda h: messages.history_line(h["role"], h["content"]))
    return F.array_join(lines, "\n")


def _asked(history: Column, message: Column, condensed: Column) -> Column:
    """The condensed question where there is a history, else the message."""
    return F.when(F.size(F.coalesce(history, F.array().cast("array<struct<content:string,role:string>>"))) > 0, condensed).otherwise(message)


def _embedded(questions: DataFrame, ports: ModelPorts, model_name: str = "", instruction: str | None = None) -> DataFrame:
    text = messages.query_text(F.lit(model_name), F.lit(instruction).cast("string"), F.col("question"))
    return questions.withColumn("embedding", ports.embed(text))


def _source(rows: DataFrame) -> Column:
    return F.struct(
        F.col("chunk_index").alias("chunkIndex"), F.col("embedding_type").alias("embeddingType"), F.col("document_id").alias("documentId"),
        "source", "title", "type", "score", "uri",
    ).cast(SOURCE)


def _with_sources(answered: DataFrame, sources: DataFrame) -> DataFrame:
    """At most n sources per question, in position order."""
    listed = sources.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "item"))), lambda s: s["item"]).alias("sources")
    )
    return answered.join(listed, "query_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast(f"array<{SOURCE}>")))


def expert(questions: DataFrame, store: KnowledgeStore, ports: ModelPorts = ModelPorts(), n: int = fixed.N_RESULTS,
           min_score: float = fixed.MIN_SCORE, budget: int = fixed.CONTEXT_CHARS) -> DataFrame:
    """(query_id, message, body_id, display_name, language) -> response rows from the body's own collection."""
    asked = questions.withColumn("collection", question_collection(F.col("body_id"))).withColumn("question", F.col("message"))
    found = store.query(_embedded(asked, ports).select("collection", "query_id", "embedding"), n)
    kept = expert_results(found, min_score, budget)
    name = F.when(F.coalesce("display_name", F.lit("")) == "", "Expert").otherwise(F.col("display_name"))
    prompt = render(fixed.EXPERT_PROMPT, vc_name=name, knowledge=F.col("context"), question=F.col("question"))
    answered = asked.join(contexts(kept, "\n"), "query_id", "left").withColumn("result", ports.answer(prompt))
    cited = first_per_source(kept)
    return _with_sources(
        answered.select("query_id", "result", F.col("language").alias("humanLanguage")),
        cited.select("query_id", "position", _source(cited).alias("item")),
    )


def retrieve_node(store: KnowledgeStore, ports: ModelPorts, n: int, min_score: float, budget: int) -> Callable[[DataFrame], DataFrame]:
    """Graph node that fills ``combined_knowledge_docs``; the question is the rephrased, the current, or the message."""

    def retrieve(states: DataFrame) -> DataFrame:
        parts = [F.nullif(F.col(c), F.lit("")) for c in ("rephrased_question", "current_question", "message") if c in states.columns]
        asked = _embedded(states.withColumn("question", F.coalesce(*parts)), ports).select("collection", "query_id", "embedding")
        kept = expert_results(store.query(asked, n), min_score, budget)
        joined = states.drop("combined_knowledge_docs").join(contexts(kept, "\n"), "query_id", "left")
        return joined.withColumn("combined_knowledge_docs", F.coalesce("context", F.lit(""))).drop("context")

    return retrieve


def expert_with_graph(questions: DataFrame, definition: dict, store: KnowledgeStore, ports: ModelPorts = ModelPorts(),
                      n: int = fixed.N_RESULTS, min_score: float = fixed.MIN_SCORE, budget: int = fixed.CONTEXT_CHARS) -> DataFrame:
    """Questions that carry one prompt graph; ``history`` is an array of (content, role)."""
    turns = F.concat(
        F.transform(F.coalesce("history", F.array().cast("array<struct<content:string,role:string>>")),
                    lambda h: messages.turn_block(h["role"], h["content"])),
        F.array(messages.turn_block(F.lit("human"), F.col("message"))),
    )
    states = questions.select(
        "query_id", "message", "language", question_collection(F.col("body_id")).alias("collection"),
        F.col("message").alias("current_question"), F.array_join(turns, "\n").alias("conversation"),
        F.coalesce("body_id", F.lit("")).alias("bok_id"), "description", "display_name",
    )
    graph = PromptGraph.from_definition(definition).compile(
        ports.answer, {"retrieve": retrieve_node(store, ports, n, min_score, budget)}
    )
    final = graph.run(graph.initial(states))

    def held(name: str) -> Column:
        return F.col(name) if name in final.columns else F.lit(None).cast("string")

    result = held("final_answer") if "final_answer" in final.columns else F.coalesce(held("result"), F.lit(""))
    return final.select(
        "query_id", result.alias("result"), F.col("language").alias("humanLanguage"), held("result_language").alias("resultLanguage"),
        held("knowledge_language").alias("knowledgeLanguage"), held("original_result").alias("originalResult"),
        F.array().cast(f"array<{SOURCE}>").alias("sources"),
    )


def guidance(questions: DataFrame, store: KnowledgeStore, collections: list[str], ports: ModelPorts = ModelPorts(),
             n: int = fixed.N_RESULTS, min_score: float = fixed.MIN_SCORE, budget: int = fixed.CONTEXT_CHARS) -> DataFrame:
    """(query_id, message, language, history) -> response rows from several collections in the given order."""
    condense = render(fixed.GUIDANCE_CONDENSE_PROMPT, chat_history=history_text(F.col("history")), question=F.col("message"))
    asked = questions.withColumn("_condensed", ports.condense(condense)).withColumn(
        "question", _asked(F.col("history"), F.col("message"), F.col("_condensed"))
    )
    targets = _embedded(asked, ports).select(
        "query_id", "embedding", F.explode(F.array(*[F.lit(c) for c in collections])).alias("collection")
    )
    order = F.lit(len(collections))
    for i, name in enumerate(collections):
        order = F.when(F.col("collection") == name, i).otherwise(order)
    kept = guidance_results(store.query(targets, n), order, n, min_score, budget)
    language = F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("EN"))
    prompt = render(
        fixed.GUIDANCE_ANSWER_PROMPT, context=F.coalesce("context", F.lit(fixed.NO_CONTEXT)), question=F.col("question"), language=language
    )
    answered = asked.join(contexts(kept, "\n\n"), "query_id", "left").withColumn("_raw", ports.answer(prompt))
    sources = kept.select("query_id", "position", F.struct(
        F.lit(None).alias("chunkIndex"), F.lit(None).alias("embeddingType"), F.lit(None).alias("documentId"), F.col("source").alias("source"),
        F.col("metadata.title").alias("title"), F.lit(None).alias("type"), F.col("score").alias("score"), F.col("source").alias("uri"),
    ).cast(SOURCE).alias("item"))
    return _with_sources(answered.select("query_id", answer_text(F.col("_raw")).alias("result"), language.alias("humanLanguage")), sources)


def generic(questions: DataFrame, ports: ModelPorts = ModelPorts()) -> DataFrame:
    """(query_id, message, history, prompt) -> the model's answer to system prompts and question."""
    lines = F.concat(F.lit("History:\n"), history_text(F.col("history")), F.lit("\n\nLatest question: "), F.col("message"))
    condensed = ports.condense(F.concat(F.lit(fixed.GENERIC_CONDENSE_SYSTEM), F.lit("\n"), lines))
    asked = questions.withColumn("_condensed", condensed).withColumn(
        "question", _asked(F.col("history"), F.col("message"), F.col("_condensed"))
    )
    built = messages.assembled(F.col("prompt"), F.col("question"))
    text = F.array_join(F.transform(built, lambda m: messages.history_line(m["role"], m["content"])), "\n")
    return asked.select("query_id", ports.answer(text).alias("result"))


def assistant(questions: DataFrame, ports: ModelPorts = ModelPorts()) -> DataFrame:
    """Assistant answers without citation marks; missing credentials are an error result."""
    no_key = F.coalesce("api_key", F.lit("")) == ""
    no_assistant = F.coalesce("assistant_id", F.lit("")) == ""
    asked = ports.answer(F.when(~no_key & ~no_assistant, F.col("message")))
    return questions.withColumn("_raw", asked).select(
        "query_id",
        F.when(no_key, "Error: Missing API key in externalConfig")
        .when(no_assistant, "Error: Missing assistantId in externalConfig")
        .otherwise(strip_citations(F.col("_raw"))).alias("result"),
        F.when(~no_key & ~no_assistant, F.coalesce("thread_id", F.concat(F.lit("thread-"), F.col("query_id")))).alias("threadId"),
    )


def handlers(store: KnowledgeStore, collections: list[str], ports: ModelPorts = ModelPorts()) -> dict[str, Callable[[DataFrame], DataFrame]]:
    return {
        "expert": partial(expert, store=store, ports=ports),
        "guidance": partial(guidance, store=store, collections=collections, ports=ports),
        "generic": partial(generic, ports=ports),
        "assistant": partial(assistant, ports=ports),
    }
