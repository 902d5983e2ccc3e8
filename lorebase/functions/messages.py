"""Chat messages: history text, role mapping, prompt assembly, query instructions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase import fixed


def speaker(role: Column) -> Column:
    """Role of a message as a chat model names it; anything unknown is a human turn."""
    role = F.coalesce(role, F.lit("human"))
    return F.when(role == "system", "system").when(role.isin("assistant", "ai"), "ai").otherwise("human")


def chat_messages(messages: Column) -> Column:
    return F.transform(messages, lambda m: F.struct(
        speaker(m["role"]).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")
    ))


def history_line(role: Column, content: Column) -> Column:
    return F.concat(F.coalesce(role, F.lit("human")), F.lit(": "), F.coalesce(content, F.lit("")))


def turn_block(role: Column, content: Column) -> Column:
    return F.concat(role, F.lit(":\n"), content)


def assembled(system_prompts: Column, question: Column) -> Column:
    """System prompts in order, then the question as the human turn."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    empty = F.array().cast("array<struct<role:string,content:string>>")
    systems = F.coalesce(F.transform(system_prompts, lambda p: message("system", p)), empty)
    return F.concat(systems, F.array(message("human", question)))


def query_instruction(model_name: Column, explicit: Column) -> Column:
    """An explicit prefix wins, the empty one included; known instruct models get the built-in one."""
    known = F.lower(model_name).startswith(fixed.QWEN_PREFIX)
    return F.coalesce(explicit, F.when(known, fixed.QWEN_INSTRUCTION), F.lit(""))


def query_text(model_name: Column, explicit: Column, question: Column) -> Column:
    """Queries carry the instruction; documents never do."""
    return F.concat(query_instruction(model_name, explicit), question)
