"""The evaluation protocol, validated fail-closed on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

#: The flags that must be present and exactly False.
AUTHORITY_FLAGS = ("edge_verified", "paper_authorized", "testnet_authorized", "live_authorized")
READINESS_FLAGS = ("EDGE_VERIFIED", "holdout_accessed", "paper_authorized", "testnet_authorized", "live_authorized")


class ProtocolError(ValueError):
    """The protocol or a report lacks an authority restriction or has an invalid setting."""


@dataclass(frozen=True)
class WalkForward:
    min_train_rows: int
    test_rows: int
    step_rows: int
    purge_rows: int
    embargo_rows: int

    @property
    def minimum(self) -> int:
        return self.min_train_rows + self.purge_rows + self.test_rows


@dataclass(frozen=True)
class Costs:
    taker_fee_bps: float = 4.0
    maker_fee_bps: float = 2.0
    default_half_spread_bps: float = 1.0
    default_slippage_bps: float = 2.0
    execution_style: str = "taker"

    @property
    def fee_bps(self) -> float:
        if self.execution_style not in ("taker", "maker"):
            raise ProtocolError(f"unknown execution style {self.execution_style!r}")
        return self.taker_fee_bps if self.execution_style == "taker" else self.maker_fee_bps


@dataclass(frozen=True)
class Protocol:
    walk_forward: WalkForward
    entry_threshold: float
    clip: float
    costs: Costs
    annualization: int
    screen: dict[str, Any]
    feature_sets: dict[str, list[str]]
    experiment_id: str = ""
    extra: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, raw: dict[str, Any]) -> Protocol:
        authority = raw.get("authority", {})
        if bad := [k for k in AUTHORITY_FLAGS if authority.get(k) is not False]:
            raise ProtocolError(f"the protocol must set {', '.join(bad)} to false")
        if authority.get("holdout_access") != "FORBIDDEN":
            raise ProtocolError("the protocol must forbid access to the holdout")
        signal = raw["signal"]
        threshold, clip = float(signal["entry_threshold"]), float(signal["feature_clip_abs_z"])
        if not (0 < threshold <= 1 and clip > 0):
            raise ProtocolError("entry_threshold must be in (0, 1] and feature_clip_abs_z positive")
        costs = raw["cost_model"]
        return cls(
            WalkForward(**{k: int(raw["walk_forward"][k]) for k in WalkForward.__dataclass_fields__}),
            threshold, clip,
            Costs(**{k: (str if k == "execution_style" else float)(costs[v]) for k, v in (("taker_fee_bps", "taker_fee_bps"), ("maker_fee_bps", "maker_fee_bps"), ("default_half_spread_bps", "default_half_spread_bps"), ("default_slippage_bps", "default_slippage_bps"), ("execution_style", "execution_style"))}),
            int(raw["annualization_periods"]), dict(raw["candidate_screen"]), {k: list(v) for k, v in raw["feature_sets"].items()}, str(raw.get("experiment_id", "")), raw,
        )

    @classmethod
    def load(cls, path: str) -> Protocol:
        with open(path, encoding="utf-8") as f:
            return cls.of(json.load(f))


def require_research_only(readiness: dict[str, Any]) -> None:
    if bad := [k for k in READINESS_FLAGS if readiness.get(k) is not False]:
        raise ProtocolError(f"{', '.join(bad)} must be false")


#: Each feature set adds to the one before.
_STEPS = (
    ("momentum_1h", "momentum_4h", "momentum_1d"),
    ("cross_crypto_leadlag",),
    ("funding_z", "oi_change_z", "basis_z", "taker_imbalance"),
    ("order_flow_imbalance", "book_imbalance", "microprice_edge"),
    ("onchain_activity_z", "exchange_netflow_z", "network_growth_z"),
    ("sentiment_z", "news_novelty"),
    ("llm_event_score", "llm_event_confidence"),
    ("regime_trend", "regime_volatility"),
)
FEATURE_SETS = {f"M{k}": [name for step in _STEPS[: k + 1] for name in step] for k in range(len(_STEPS))}


def default_protocol(**changes: Any) -> dict[str, Any]:
    """The standard protocol as plain data; keyword arguments replace whole sections."""
    # fixed values: keys, sections and settings
    return {
        "schema_version": "1.0.0", "experiment_id": "walk_forward_default", "mode": "RESEARCH_ONLY",
        "authority": {**dict.fromkeys(AUTHORITY_FLAGS, False), "holdout_access": "FORBIDDEN"},
        "walk_forward": {"min_train_rows": 240, "test_rows": 72, "step_rows": 72, "purge_rows": 1, "embargo_rows": 1},
        "signal": {"entry_threshold": 0.20, "feature_clip_abs_z": 3.0},
        "cost_model": {"taker_fee_bps": 4.0, "maker_fee_bps": 2.0, "default_half_spread_bps": 1.0, "default_slippage_bps": 2.0, "execution_style": "taker"},
        "annualization_periods": 8760,
        "candidate_screen": {"require_net_return_positive": True, "require_simple_alpha_positive": True, "require_positive_fold_fraction": 0.6, "require_sharpe_positive": True},
        "feature_sets": FEATURE_SETS,
    } | changes
