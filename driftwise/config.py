"""Metric contracts and the fixed values the jobs compare against.

A contract is driver-side configuration: a few dozen short records, never data.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Driver:
    driver_id: str
    source: str
    lever: str | None = None
    owner: str | None = None
    elasticity: float | None = None


@dataclass(frozen=True)
class Kpi:
    """One metric: how it is built, rolled up, judged and owned."""

    kpi_id: str
    shape: str                      # net | orders | order_value | conversion | on_time
    unit: str                       # INR | count | ratio
    grain: str                      # hour | day | week
    dims: tuple[str, ...]
    owner: str
    transforms: tuple[str, ...]
    aggregation: str = "sum"        # sum | mean | ratio_of_sums
    numerator: str | None = None
    denominator: str | None = None
    noise_model: str = "binomial"   # binomial | counting
    parents: tuple[str, ...] = ()
    drivers: tuple[Driver, ...] = ()
    min_abs_z: float = 3.0
    min_abs_money: float = 15000.0
    value_per_unit: float = 1.0
    gross_margin: float | None = None
    channels: tuple[str, ...] = ()
    sla_hours: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.aggregation == "ratio_of_sums" and not (self.numerator and self.denominator):
            raise ValueError(f"{self.kpi_id}: a ratio needs its numerator and denominator")
        if self.unit == "ratio" and self.aggregation != "ratio_of_sums":
            raise ValueError(f"{self.kpi_id}: a ratio is never averaged or summed over slices")
        if self.noise_model not in ("binomial", "counting"):
            raise ValueError(f"{self.kpi_id}: unknown noise model {self.noise_model!r}")


SALES_DIMS = ("region", "channel", "category", "device")


def _vertical(names: dict[str, tuple], channels: tuple[str, ...], counting: tuple[str, ...],
              drivers: dict[str, tuple[Driver, ...]]) -> dict[str, Kpi]:
    """The five metric shapes of one industry under that industry's names."""
    net, orders, value, conv, on_time = (names[k] for k in
                                         ("net", "orders", "order_value", "conversion", "on_time"))
    noise = lambda kpi: "counting" if kpi in counting else "binomial"
    return {k.kpi_id: k for k in (
        Kpi(net[0], "net", "INR", "day", SALES_DIMS, net[1],
            ("dedupe_order_id", "tz_normalise", "net_returns"),
            min_abs_money=net[2], value_per_unit=net[3], gross_margin=net[4],
            drivers=drivers.get("net", ()),
            sla_hours={"pos_txn": 6, "plan_ops": 72, "voice_ops": 2, "ext_signals": 36}),
        Kpi(orders[0], "orders", "count", "day", SALES_DIMS, orders[1],
            ("dedupe_order_id", "tz_normalise", "exclude_test_accounts"),
            min_abs_money=orders[2], value_per_unit=orders[3], parents=(net[0],),
            drivers=drivers.get("orders", ()),
            sla_hours={"pos_txn": 6, "plan_ops": 72, "ext_signals": 36}),
        Kpi(value[0], "order_value", "INR", "day", SALES_DIMS, value[1],
            ("dedupe_order_id", "tz_normalise", "exclude_test_accounts", "net_returns"),
            aggregation="ratio_of_sums", numerator=value[4], denominator=value[5],
            min_abs_money=value[2], value_per_unit=value[3], parents=(net[0],),
            drivers=drivers.get("order_value", ()),
            sla_hours={"pos_txn": 6, "plan_ops": 72}),
        Kpi(conv[0], "conversion", "ratio", "hour", ("region", "device"), conv[1],
            ("tz_normalise", "exclude_test_accounts"),
            aggregation="ratio_of_sums", numerator=conv[4], denominator=conv[5],
            noise_model=noise(conv[0]), parents=(orders[0],), channels=channels,
            min_abs_money=conv[2], value_per_unit=conv[3],
            drivers=drivers.get("conversion", ()),
            sla_hours={"pos_txn": 6, "voice_ops": 2}),
        Kpi(on_time[0], "on_time", "ratio", "day", ("region", "category"), on_time[1],
            ("exclude_in_flight",),
            aggregation="ratio_of_sums", numerator=on_time[4], denominator=on_time[5],
            noise_model=noise(on_time[0]), min_abs_z=2.5,
            min_abs_money=on_time[2], value_per_unit=on_time[3],
            drivers=drivers.get("on_time", ()),
            sla_hours={"plan_ops": 72, "ext_signals": 36}),
    )}


# Names, owners, floors (money), value per unit of each contract.
RETAIL = _vertical(
    {
        "net": ("net_revenue", "finance_director", 15000.0, 1.0, 0.32),
        "orders": ("orders", "commercial_director", 15000.0, 447.0),
        "order_value": ("aov", "category_manager", 15000.0, 411.0, "net_revenue", "orders"),
        "conversion": ("checkout_conversion", "ecommerce_lead", 625.0, 126500.0,
                       "converted", "sessions"),
        "on_time": ("on_time_delivery", "supply_planner", 15000.0, 91858.0,
                    "on_time", "shipments"),
    },
    channels=("web", "app"),
    counting=(),
    drivers={
        "net": (
            Driver("unit_price", "pos_txn", "pricing", "category_manager", -1.4),
            Driver("marketing_spend", "plan_ops", "media_budget", "marketing_lead", 0.3),
            Driver("stock_position", "plan_ops", "replenishment", "supply_planner"),
            Driver("release_quality", "voice_ops", "release_rollback", "ecommerce_lead"),
            Driver("competitor_price_index", "plan_ops"),
            Driver("severe_weather", "ext_signals"),
        ),
        "orders": (
            Driver("marketing_spend", "plan_ops", "media_budget", "marketing_lead", 0.4),
            Driver("stock_position", "plan_ops", "replenishment", "supply_planner"),
            Driver("severe_weather", "ext_signals"),
        ),
        "order_value": (
            Driver("unit_price", "pos_txn", "pricing", "category_manager", -1.4),
            Driver("product_mix", "pos_txn", "assortment", "category_manager"),
            Driver("competitor_price_index", "plan_ops"),
        ),
        "conversion": (
            Driver("app_release", "voice_ops", "release_rollback", "ecommerce_lead"),
            Driver("payment_gateway_health", "voice_ops", "gateway_failover", "platform_lead"),
            Driver("unit_price", "pos_txn", "pricing", "category_manager", -0.8),
        ),
        "on_time": (
            Driver("carrier_performance", "plan_ops", "carrier_mix", "supply_planner"),
            Driver("stock_position", "plan_ops", "replenishment", "supply_planner"),
            Driver("severe_weather", "ext_signals"),
        ),
    },
)

_DUTY = Driver("excise_duty", "plan_ops", "pricing_revision", "pricing_manager", -0.2)
_REFINERY = Driver("refinery_availability", "voice_ops", "alternate_sourcing", "supply_manager")
_PIPELINE = Driver("pipeline_integrity", "voice_ops", "mode_switch", "logistics_lead")
_FLEET = Driver("carrier_capacity", "plan_ops", "fleet_augmentation", "logistics_lead")
_CRUDE, _PORT = Driver("crude_benchmark", "plan_ops"), Driver("port_closure", "ext_signals")

# The petroleum contracts.
PETROLEUM = _vertical(
    {
        "net": ("net_realisation", "finance_director", 5000000.0, 1.0, 0.05),
        "orders": ("consignments", "commercial_director", 5000000.0, 148075.0),
        "order_value": ("avg_consignment_value", "pricing_manager", 5000000.0, 646.0,
                        "net_realisation", "consignments"),
        "conversion": ("gantry_throughput", "terminal_manager", 208333.0, 61451125.0,
                       "lifted", "scheduled"),
        "on_time": ("supply_reliability", "supply_manager", 5000000.0, 32000000.0,
                    "on_time", "consignments"),
    },
    channels=("retail", "direct"),
    counting=("supply_reliability",),
    drivers={
        "net": (_DUTY, _REFINERY, _PIPELINE, _FLEET, _CRUDE, _PORT),
        "orders": (_REFINERY, _FLEET, _PORT),
        "order_value": (_DUTY, Driver("product_mix", "pos_txn", "allocation_mix", "supply_manager"),
                        _CRUDE),
        "conversion": (_FLEET, _REFINERY, _PORT),
        "on_time": (_FLEET, _PIPELINE, _PORT),
    },
)

_TARIFF = Driver("tariff_order", "plan_ops", "regulatory_filing", "regulatory_lead", -0.3)
_FUEL = Driver("fuel_supply", "voice_ops", "fuel_sourcing", "fuel_manager")
_PLANT = Driver("plant_availability", "voice_ops", "outage_rescheduling", "station_head")
_GRID = Driver("grid_constraint", "plan_ops", "corridor_booking", "trading_head")
_DEMAND, _WEATHER = Driver("demand_shift", "plan_ops"), Driver("weather_load", "ext_signals")

# The power contracts.
POWER = _vertical(
    {
        "net": ("dispatch_realisation", "finance_director", 350000.0, 1.0, 0.22),
        "orders": ("scheduled_blocks", "trading_head", 350000.0, 6399.0),
        "order_value": ("avg_realised_tariff", "regulatory_lead", 350000.0, 1060.0,
                        "dispatch_realisation", "blocks"),
        "conversion": ("dispatch_fulfilment", "system_operator", 14583.0, 360265.0,
                       "delivered", "scheduled"),
        "on_time": ("grid_availability", "system_operator", 350000.0, 2260000.0,
                    "available", "declared"),
    },
    channels=("ppa", "exchange"),
    counting=("dispatch_fulfilment", "grid_availability"),
    drivers={
        "net": (_TARIFF, _FUEL, _PLANT, _GRID, _DEMAND, _WEATHER),
        "orders": (_FUEL, _GRID, _WEATHER),
        "order_value": (_TARIFF, Driver("fuel_mix", "pos_txn", "despatch_mix", "trading_head"), _DEMAND),
        "conversion": (_PLANT, _FUEL, _WEATHER),
        "on_time": (_FUEL, _GRID, _WEATHER),
    },
)

UK_RETAIL = Kpi("uk_net_revenue", "net", "INR", "day", ("region",), "finance_director", (),
                min_abs_money=5000.0)

# Which labels the traffic feed uses for its three routes, by industry.
ROUTES = {
    "retail": ("web", "app", "store"),
    "petroleum": ("retail", "direct", "aviation"),
    "power": ("ppa", "exchange", "banking"),
}

# Seasonal cycle per grain, in observations, and history needed.
SEASONAL_PERIOD = {"hour": 24, "day": 7, "week": 52}
MIN_CYCLES = 4
MIN_OBSERVATIONS = 60
MAD_TO_SIGMA = 0.6745
EPISODE_GAP_DAYS = 2

# The shape of a festival's pull on demand.
BUILD_UP_DAYS = 18
HANGOVER_DAYS = 7
HANGOVER_DEPTH = 0.25

# Peak days and their weight; a deployment supplies its own.
FESTIVALS = (
    ("1995-03-17", 0.25), ("1995-10-03", 0.35), ("1995-10-23", 0.85), ("1995-12-25", 0.20),
    ("1996-03-05", 0.25), ("1996-10-20", 0.35), ("1996-11-10", 0.85), ("1996-12-25", 0.20),
    ("1997-03-24", 0.25), ("1997-10-11", 0.35), ("1997-10-30", 0.85), ("1997-12-25", 0.20),
    ("1998-03-13", 0.25), ("1998-10-01", 0.35), ("1998-10-19", 0.85), ("1998-12-25", 0.20),
    ("1999-03-02", 0.25), ("1999-10-19", 0.35), ("1999-11-07", 0.85), ("1999-12-25", 0.20),
    ("2000-03-20", 0.25), ("2000-10-07", 0.35), ("2000-10-26", 0.85), ("2000-12-25", 0.20),
    ("2001-03-10", 0.25), ("2001-10-26", 0.35), ("2001-11-14", 0.85), ("2001-12-25", 0.20),
)

# Causal test floors and windows.
BASELINE_DAYS = 14
EFFECT_FLOOR = 0.04
CONSISTENCY_FLOOR = 0.5
PLACEBO_WINDOWS = 6
PLACEBO_STEP_DAYS = 14
PLACEBO_MIN = 3
PLACEBO_MARGIN = 1.25
ISOLATION_SHARE = 0.6
LEAD_TOLERANCE_DAYS = 7
LAG_TOLERANCE_DAYS = 2
NOTE_WINDOW_DAYS = 10
PLAN_WINDOW_DAYS = 14

# Reconciliation.
RECONCILE_TOLERANCE = 0.05
CONTRADICTION_MULTIPLE = 3.0
IDENTITY_TOLERANCE = 0.10

# Confidence weights and cut-offs.
CONFIDENCE_WEIGHTS = {
    "coverage": 0.35, "causal_strength": 0.30, "corroboration": 0.20, "freshness": 0.15,
}
MIN_COVERAGE = 0.45
ABSTAIN_BELOW = 0.45
HIGH_ABOVE = 0.70
CORROBORATION_SATURATION = 3
STRENGTH_SATURATION = 3.0

# What makes an outside warning usable, and how precedents are cut.
MIN_LEAD_HOURS = 24.0
ACTIONABLE_SEVERITY = ("amber", "red")
SEVERITY_ORDER = ("green", "yellow", "amber", "red")
PRECEDENT_LOOKBACK_DAYS = 730
PRECEDENT_GAP_DAYS = 5
PRECEDENT_DROP = 0.06
PRECEDENT_BASELINE_DAYS = 28
PRECEDENT_MIN_ROWS = 7

# Share of a measured loss each lever recovers.
RECOVERY_SHARE = {
    "release_rollback": 0.90, "gateway_failover": 0.85, "replenishment": 0.65,
    "carrier_mix": 0.55, "pricing": 0.50, "media_budget": 0.40, "assortment": 0.35,
}

# Feedback quorum and limits.
QUORUM = 2
CONTESTED_ABOVE = 0.25
MAX_RAISE_MULTIPLE = 2.0
LEARNABLE = {
    "wrong_cause": "candidate_ranking",
    "missed_cause": "candidate_source",
    "not_material": "materiality_threshold",
    "wrong_owner": "driver_mapping",
    "noise_source": "retrieval_filter",
}

# Which units each method may report in.
METHOD_UNITS = {
    "pvm_bridge": ("INR",),
    "dimensional_contribution": ("INR", "pct"),
    "mstl_robust_z": ("ratio",),
    "materiality": ("INR", "ratio"),
    "ridge": ("ratio",),
    "lasso": ("ratio",),
    "did": ("INR", "pct_point"),
    "event_time_isolation": ("none",),
    "placebo": ("none",),
    "retrieval": ("count", "none"),
    "signal_gap": ("hours", "count", "none"),
    "freshness": ("hours",),
}
