"""Phrase banks: our own texts in named lists, JSON files that replace them, and template filling."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of units that users pick from, long names, unit weights, and how often line breaks collapse.
UNIT_VARIANTS = {
    "km": ["km", "Km", "KM", "kms", "Kms", "k", "K", "km.", "klick", "klicks", "click", "clicks", "kilometer", "kilometre", "kilometers", "kilometres", "meters", "metres", "meter", "metre", "mtrs", "mtr"],
    "mi": ["mi", "Mi", "MI", "mile", "miles", "sm", "mi.", "m", "M", "m.", "give it to me in m", "statute", "statute miles"],
    "nmi": ["nmi", "nm", "NM", "nautical mile", "nautical miles", "sea mile", "sea miles", "n.m.", "n mi"],
}
LONG_NAMES = {"km": ["km", "kilometers", "kilometres", "km.", "kilometer(s)", "kilometre(s)"], "mi": ["miles", "mi", "statute miles", "statute"], "nmi": ["nautical miles", "nmi", "nm", "sea miles"]}
DEFAULT_UNIT = {"km": 0.60, "mi": 0.35, "nmi": 0.05}
FORMAT_NOISE = {
    "analysis": {"p_collapse_all": 0.06, "p_collapse_some": 0.18, "collapse_some_fraction_range": [0.20, 0.50], "p_compact_bullets": 0.20},
    "final": {"p_collapse_all": 0.10, "p_collapse_some": 0.30, "collapse_some_fraction_range": [0.15, 0.50], "p_compact_bullets": 0.00},
}

SYSTEM = "You work out distances between two points on Earth. Put your reasoning in <analysis> and one number with its unit in <final>."
#: Every text below is ours; a bank read from JSON may replace any of them.
BANK: dict = {
    "user_patterns": ["Give me the distance between {A} and {B} in {unit}.", "{unit} between {A} and {B}?", "I need to get from {A} to {B}; how many {unit} is that?", "Straight line {A} to {B}, answer in {unit} please", "How many {unit} separate {A} from {B}?", "what's the gap from {A} to {B}"],
    "intent_openers": ["So the task:", "Reading the request:", "To begin:"],
    "intent_explicit": ["{op} they want the result in {unit_long}.", "{op} the unit is stated, {unit_long}."],
    "intent_ambiguous": ["{op} '{raw_unit}' could mean several units; {unit_long} fits best."],
    "intent_default": ["{op} no unit is given, so {unit_long} will do.", "{op} I pick {unit_long}, as none was named."],
    "intent_coords": ["Start {alat}, {alon}; end {blat}, {blon}.", "From ({alat}, {alon}) to ({blat}, {blon})."],
    "analysis_openers": ["A rough size first, then the exact value.", "Let me estimate before computing."],
    "gut_openers": ["Rough size:", "As a first estimate:"],
    "why_small": ["Over a short span the grid is nearly flat at {mid_lat}°.", "A flat right triangle gets close to {ball_km} km."],
    "why_large": ["The arc is {frac_pct} % of a full circle.", "Ten degrees are about {per10deg_km} km.", "Half way round is {half_circum_km} km.", "{unknown} stays as it is."],
    "method_transitions": ["For the exact value I take", "Now precisely, by"],
    "haversine_names": ["the haversine formula", "haversine on a sphere"],
    "vincenty_names": ["Vincenty's inverse method", "the WGS-84 inverse solution"],
    "haversine_overview": ["Half-angle sines give the central angle; times the radius it is the distance."],
    "vincenty_overview": ["The longitude difference on the auxiliary sphere is iterated until it settles."],
    "calc_intro": ["Working through {method_label}:"],
    "fallback": ["The iteration does not settle for these nearly opposite points, so the sphere has to do."],
    "final_intro": ["Here is how it goes.", "Step by step:"],
    "step1": ["1) Coordinates", "Reading the points"],
    "convert": ["In decimal degrees", "Converted"],
    "method_used": ["Method: {method_label}.", "Computed with {method_label}."],
    "unit_heading": ["Unit", "Into the unit asked for"],
    "compare": ["The rough value was {approx_km} km against {exact_km} km, off by {diff_km} km ({diff_pct} %)."],
    "answer": ["Answer", "Result"],
}


def load_required(directory: str | Path, name: str):
    """JSON that has to be there: FileNotFoundError if it isn't, ValueError if it can't be read."""
    path = Path(directory) / name
    if not path.is_file():
        raise FileNotFoundError(path)
    try:
        return json.loads(path.read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise ValueError(f"{path}: {e}") from e


def load_or(directory: str | Path, name: str, default):
    """JSON if it is there and can be read, else the default."""
    try:
        return load_required(directory, name)
    except (FileNotFoundError, ValueError):
        return default


def require_keys(found: Mapping, keys: Sequence[str], what: str = "config") -> None:
    if missing := [k for k in keys if k not in found]:
        raise KeyError(f"{what} lacks {', '.join(missing)}")


def bank_from(directory: str | Path | None = None) -> dict:
    """The bank, with the lists that `bank.json` in a directory replaces."""
    own = load_or(directory, "bank.json", {}) if directory else {}
    return BANK | own


def fill(template: str, slots: Mapping[str, Column]) -> Column:
    """A template's slots replaced by columns; an unknown slot stays as it is."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            parts += [F.lit(piece)] if piece else []
        else:
            parts.append(slots[piece].cast("string") if piece in slots else F.lit("{" + piece + "}"))
    return F.concat(*parts) if parts else F.lit("")


def fill_any(templates: Sequence[str], slots: Mapping[str, Column], draws, slot: str) -> Column:
    """One of the templates, filled."""
    return draws.one_of([fill(t, slots) for t in templates], slot)
