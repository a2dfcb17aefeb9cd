"""Chat messages as arrays of structs, and their renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import let

MESSAGE = "struct<role:string,content:string,thinking:string>"
#: How much reasoning a prompt asks for, in words of our own; only the names of the levels and the two tags are fixed.
HINTS = {
    "low": "\n\nOne or two lines inside <analysis> are enough; the distance alone belongs inside <final>.",
    "medium": "\n\nList the main steps inside <analysis>, then state a single distance inside <final>.",
    "high": "\n\nWork through every step inside <analysis> and check it once more; close with a single distance inside <final>.",
}
CONCISE = "\n\nGive only the distance with its unit, on one line."


def effort_hint(effort: Column) -> Column:
    e = F.lower(F.trim(F.coalesce(effort, F.lit(""))))
    out = F.lit("")
    for name, hint in HINTS.items():
        out = F.when(e == name, hint).otherwise(out)
    return out


def message(role: str, content: Column, thinking: Column | None = None) -> Column:
    return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"), (F.lit(None) if thinking is None else thinking).cast("string").alias("thinking"))


def build_messages(developer: Column, user: Column, concise: bool = False) -> Column:
    return F.array(message("system", developer), message("user", F.concat(user, F.lit(CONCISE)) if concise else user))


def render_harmony(messages: Column, effort: Column) -> Column:
    """Wire format with start, message and end marks; the hint goes to the system message."""
    body = lambda m: F.concat(F.coalesce(m.content, F.lit("")), F.when(m.role == "system", effort_hint(effort)).otherwise(""))
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|start|>"), m.role, F.lit("<|message|>"), body(m), F.lit("<|end|>"))), "")


def render_naive(messages: Column) -> Column:
    """Role headings, contents and blank lines, and a heading for the answer."""
    each = F.transform(messages, lambda m: F.concat(F.lit("["), F.upper(m.role), F.lit("]\n"), F.regexp_replace(m.content, r"(?U)\s+$", "")))
    return F.concat(F.array_join(each, "\n\n"), F.lit("\n\n[ASSISTANT]\n"))


def harmony_row(turns: Column) -> Column:
    """Struct developer, user, analysis, final, messages from turns (role, channel, content); the first of each counts, analysis may lack."""

    def found(t: Column) -> Column:
        first = lambda role, channel=None: F.get(F.filter(t, lambda m: (m.role == role) & (F.lit(True) if channel is None else m.channel == channel)), F.lit(0)).content
        own = {"developer": first("system"), "user": first("user"), "analysis": first("assistant", "analysis"), "final": first("assistant", "final")}
        return F.struct(*[c.alias(n) for n, c in own.items()])

    def row(r: Column) -> Column:
        said = F.array(message("system", r.developer), message("user", r.user), message("assistant", r.final, r.analysis))
        return F.struct(*[r[n].alias(n) for n in ("developer", "user", "analysis", "final")], said.alias("messages"))

    return let(let(turns, found), row)


def peek(messages: Column, most: int = 5, chars: int = 120) -> Column:
    """First messages, cut short, on one line each, with a flag for thinking."""
    return F.transform(F.slice(messages, 1, most), lambda m: F.concat(m.role, F.lit(": "), F.replace(F.substring(F.coalesce(m.content, F.lit("")), 1, chars), F.lit("\n"), F.lit(" ")), F.when(F.coalesce(m.thinking, F.lit("")) != "", " [thinking]").otherwise("")))
