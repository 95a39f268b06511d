"""How each industry words its complaints and its slices.

Fixed values throughout: phrases are matched as written, in the order given.
"""

from __future__ import annotations

from dataclasses import dataclass

from driftwise.functions.text import ISSUE_TERMS, NOT_IN_COMPLAINTS, RELATED_ISSUES, SCOPE_TERMS


@dataclass(frozen=True)
class Vocabulary:
    issue_terms: tuple[tuple[str, tuple[str, ...]], ...]
    scope_terms: dict[str, dict[str, str]]
    related: dict[str, tuple[str, ...]]
    company_words: tuple[str, ...]


RETAIL = Vocabulary(ISSUE_TERMS, SCOPE_TERMS, RELATED_ISSUES, NOT_IN_COMPLAINTS)

PETROLEUM = Vocabulary(
    issue_terms=(
        ("gantry_failure", (
            "gantry down", "loading arm", "loading bay", "could not load", "unable to load",
            "gantry queue", "loading halted", "bay closed", "meter fault", "tanker turned away")),
        ("documentation_hold", (
            "invoice not generated", "indent rejected", "delivery order", "documentation hold",
            "e-way bill", "credit limit", "payment gateway", "indent could not")),
        ("supply_delay", (
            "truck delayed", "arrived late", "did not arrive", "no delivery", "supply delayed",
            "rake delayed", "pipeline shut", "pipeline down", "berth", "vessel", "cyclone",
            "flooding", "road closed", "depot closed", "no update for")),
        ("stock_dry_out", (
            "dry out", "dried out", "ran out", "nil stock", "no stock", "tank empty",
            "out of stock", "allocation cut", "rationing", "allocation reduced",
            "allocation running", "allocation restricted", "of indent", "short supply")),
        ("price_revision", (
            "price revision", "rate revision", "duty change", "excise", "price went up",
            "cheaper at", "margin", "dealer commission")),
        ("quality_offspec", (
            "off-spec", "off spec", "contaminated", "water in", "density", "flash point",
            "quality was", "sediment")),
    ),
    scope_terms={
        "channel": {
            "retail outlet": "retail", "petrol pump": "retail", "pump": "retail",
            "dealer": "retail", "direct": "direct", "industrial": "direct", "bulk": "direct",
            "consumer pump": "direct", "aviation": "aviation", "afs": "aviation",
            "airport": "aviation"},
        "device": {
            "tank truck": "tank_truck", "tanker": "tank_truck", "truck": "tank_truck",
            "rake": "rail", "rail": "rail", "wagon": "rail", "pipeline": "pipeline",
            "pumping": "pipeline"},
        "category": {
            "petrol": "motor_fuels", "diesel": "motor_fuels", "hsd": "motor_fuels",
            "ms ": "motor_fuels", "motor spirit": "motor_fuels", "atf": "aviation_fuel",
            "jet fuel": "aviation_fuel", "lpg": "lpg", "cylinder": "lpg", "bitumen": "bitumen",
            "lubricant": "lubricants", "lube": "lubricants"},
    },
    related={
        "gantry_failure": ("gantry_failure", "documentation_hold"),
        "documentation_hold": ("documentation_hold", "gantry_failure"),
        "supply_delay": ("supply_delay", "stock_dry_out"),
        "stock_dry_out": ("stock_dry_out", "supply_delay"),
        "price_revision": ("price_revision",),
        "quality_offspec": ("quality_offspec",),
        "other": (),
    },
    company_words=(
        "turnaround", "circular", "notification", "schedule", "allocation plan", "benchmark",
        "parity", "sop", "process", "planning", "advisory"),
)

POWER = Vocabulary(
    issue_terms=(
        ("dispatch_failure", (
            "unit tripped", "trip", "forced outage", "boiler", "turbine", "could not sync",
            "generation lost", "machine off bar", "off bar")),
        ("scheduling_hold", (
            "schedule revised", "revision not accepted", "declared capacity", "dc revision",
            "scheduling hold", "nomination rejected", "open access denied", "no-objection")),
        ("fuel_shortage", (
            "coal stock", "fuel shortage", "rake not received", "rakes short", "gas supply",
            "critical stock", "supercritical stock", "linkage", "fuel supply agreement")),
        ("curtailment", (
            "curtailed", "backing down", "backed down", "grid constraint",
            "transmission constraint", "line outage", "evacuation constraint", "load shed",
            "must-run cut")),
        ("tariff_revision", (
            "tariff order", "tariff revision", "true-up", "regulatory order", "rate schedule",
            "surcharge")),
        ("quality_deviation", (
            "frequency deviation", "voltage", "reactive", "deviation settlement",
            "power factor", "harmonics")),
    ),
    scope_terms={
        "channel": {
            "long-term ppa": "ppa", "ppa": "ppa", "long term": "ppa", "exchange": "exchange",
            "iex": "exchange", "spot": "exchange", "banking": "banking",
            "bilateral": "banking"},
        "device": {
            "base load": "base_load", "baseload": "base_load", "peaking": "peaking",
            "peaker": "peaking", "must-run": "must_run", "must run": "must_run"},
        "category": {
            "coal": "coal", "thermal": "coal", "boiler": "coal", "gas": "gas", "ccgt": "gas",
            "hydro": "hydro", "reservoir": "hydro", "solar": "solar", "pv": "solar",
            "wind": "wind", "turbine blade": "wind"},
    },
    related={
        "dispatch_failure": ("dispatch_failure", "scheduling_hold"),
        "scheduling_hold": ("scheduling_hold", "dispatch_failure"),
        "fuel_shortage": ("fuel_shortage", "curtailment"),
        "curtailment": ("curtailment", "fuel_shortage"),
        "tariff_revision": ("tariff_revision",),
        "quality_deviation": ("quality_deviation",),
        "other": (),
    },
    company_words=(
        "circular", "notification", "merit order", "outage plan", "schedule", "regulation",
        "sop", "process", "planning", "advisory", "benchmark"),
)
