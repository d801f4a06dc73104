"""Prompts and chat messages as column expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _filled_in(form: str, values: dict[str, Column]) -> Column:
    """A format string with columns in its places; doubled braces stand for single ones."""
    parts = [p for literal, name, *_ in Formatter().parse(form) for p in ([F.lit(literal)] if literal else []) + ([values[name]] if name else [])]
    return F.concat(*parts) if parts else F.lit("")


def instruction_format(instruction: Column, response: Column | None = None, context: Column | None = None, template: str = "alpaca", system: str | None = None) -> Column:
    """One training text; without a response it ends where the answer begins. template: alpaca, chatml or a format string with {instruction}."""
    text, none = F.lit, F.lit(None).cast("string")
    response, context = none if response is None else response, none if context is None else context
    with_context = _filled(context)
    if template == "alpaca":
        values = {"instruction": instruction, "context": context}
        return F.concat(F.when(with_context, _filled_in(fixed.ALPACA_WITH_CONTEXT, values)).otherwise(_filled_in(fixed.ALPACA_PLAIN, values)), F.coalesce(response, text("")))
    if template == "chatml":
        turn = lambda who: text(f"<|im_start|>{who}\n")
        user = F.when(with_context, F.concat(instruction, text("\n\n"), context)).otherwise(instruction)
        parts = [turn("system"), text(system), text("<|im_end|>\n")] if system else []
        return F.concat(*parts, turn("user"), user, text("<|im_end|>\n"), turn("assistant"), F.coalesce(F.concat(response, text("<|im_end|>")), text("")))
    if "{instruction}" not in template:
        raise ValueError(f"unknown template {template!r}: alpaca, chatml or a format string with {{instruction}}")
    values = {"instruction": instruction, "context": F.coalesce(context, text("")), "response": F.coalesce(response, text("")), "system": text(system or "")}

    return F.when(response.isNotNull(), _filled_in(template, values)).otherwise(_filled_in(template.split("{response}", 1)[0], values))


def is_instruction(instruction: Column, response: Column) -> Column:
    return F.coalesce(_filled(instruction), F.lit(False)) & response.isNotNull()


def training_text(text: Column, instruction: Column, response: Column, template: str = "alpaca", system: str | None = None) -> Column:
    return F.when(is_instruction(instruction, response), instruction_format(instruction, response, text, template, system)).otherwise(text)


def messages(text: Column, instruction: Column, response: Column, system: str | None = None) -> Column:
    """array<struct<role, content>>; raises on rows that aren't instructions."""
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    user = F.when(_filled(text), F.concat(instruction, F.lit("\n\n"), text)).otherwise(instruction)
    turns = F.array(*([said("system", F.lit(system))] if system else []), said("user", user), said("assistant", response))
    return F.when(is_instruction(instruction, response), turns).otherwise(F.raise_error("messages need an instruction and a response"))
