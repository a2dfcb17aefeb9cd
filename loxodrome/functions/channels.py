"""Analysis and final channels of a model's raw output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import let
from .units import STRIP

# The wire format's marks and the labels of untagged channels.
FINAL_MARK = "<|channel|>final<|message|>"
ANALYSIS_MARK = "<|channel|>analysis<|message|>"
NEXT_MARK = r"<\|channel\|>|<\|end\|>|<\|return\|>|<\|call\|>"
ANALYSIS_LABEL = r"(?iuU)(?:assistant)?\s*analysis\b[:\*]*"
FINAL_LABEL = r"(?iuU)(?:assistant)?\s*final\b[:\*]*"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def from_json_output(raw: Column) -> Column:
    """Text of a generator's JSON output (object or list of objects), or the text as it is."""
    return F.coalesce(*[F.get_json_object(raw, p) for p in ("$.generated_text", "$.text", "$[0].generated_text", "$[0].text")], raw)


def extract_tag(text: Column, tag: str) -> Column:
    """First <tag>...</tag>, whatever its case, trimmed; null if there is none."""
    pattern = rf"(?isuU)<\s*{tag}\s*>(.*?)<\s*/\s*{tag}\s*>"
    return stripped(F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0)))


def split_channels_tags(raw: Column) -> Column:
    """Struct final, analysis: by tags, else by the words analysis and final, else all of it is final."""

    def cut(t: Column) -> Column:
        def labelled(parts: Column) -> Column:
            whole = F.struct(stripped(t).alias("final"), extract_tag(t, "analysis").alias("analysis"))
            rest = let(stripped(F.get(parts, F.lit(1))), lambda r: let(F.split(r, FINAL_LABEL, 2), lambda both: parted(r, both)))
            return F.when(F.size(parts) > 1, rest).otherwise(whole)

        def parted(rest: Column, both: Column) -> Column:
            two = F.struct(stripped(F.get(both, F.lit(1))).alias("final"), stripped(F.get(both, F.lit(0))).alias("analysis"))
            return F.when(F.size(both) > 1, two).otherwise(F.struct(rest.alias("final"), extract_tag(t, "analysis").alias("analysis")))

        def tagged(final: Column) -> Column:
            return F.when(F.coalesce(final, F.lit("")) != "", F.struct(final.alias("final"), extract_tag(t, "analysis").alias("analysis"))).otherwise(let(F.split(t, ANALYSIS_LABEL, 2), labelled))

        return let(extract_tag(t, "final"), tagged)

    return let(raw, cut)


def extract_channel(text: Column, mark: str) -> Column:
    """What follows the first mark, up to the next mark, trimmed; null without the mark."""
    after = F.substring(text, F.instr(text, mark) + len(mark), F.length(text))
    return F.when(F.contains(text, F.lit(mark)), stripped(F.split(after, NEXT_MARK, -1)[0]))


def split_channels_harmony(raw: Column) -> Column:
    """Struct final (empty without its mark), analysis."""
    return F.struct(F.coalesce(extract_channel(raw, FINAL_MARK), F.lit("")).alias("final"), extract_channel(raw, ANALYSIS_MARK).alias("analysis"))


def truncated(text: Column, most: int, zero_cuts: bool = True) -> Column:
    """A channel for the log; `zero_cuts`: a limit of 0 cuts, too."""
    return F.substring(text, 1, most) if most > 0 or (zero_cuts and most == 0) else text
