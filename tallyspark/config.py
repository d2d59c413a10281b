"""Reconciliation parameters and their ranges."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

LI = 10_000  # fixed-point units a yuan


@dataclass(frozen=True)
class ReconConfig:
    performance_materiality: Decimal = Decimal("100000.00")
    clearly_trivial_threshold: Decimal = Decimal("5000.00")
    auto_confirm_score: int = 70
    tolerance_days: int = 31
    dfs_date_window: int = 31
    max_dfs_depth: int = 30
    max_candidates: int = 30
    batch_min_count: int = 10
    allow_mixed_sign: bool = False
    allow_zero_match: bool = False
    allow_greedy_fallback: bool = True
    greedy_attempts: int = 3
    random_seed: int = 0

    @property
    def materiality_li(self) -> int:
        return int(self.performance_materiality * LI)

    @property
    def trivial_li(self) -> int:
        return int(self.clearly_trivial_threshold * LI)

    def problems(self) -> list[str]:
        """What is out of range, one message each; empty if all is well."""
        ranges = {
            "tolerance_days": (0, 365), "dfs_date_window": (0, 90), "max_dfs_depth": (1, 100), "batch_min_count": (2, 1000),
            "max_candidates": (1, 200), "auto_confirm_score": (0, 100), "greedy_attempts": (1, 100),
        }
        out = [f"{k} must be from {lo} to {hi}" for k, (lo, hi) in ranges.items() if not lo <= getattr(self, k) <= hi]
        out += [f"{k} must not be negative" for k in ("performance_materiality", "clearly_trivial_threshold") if getattr(self, k) < 0]
        if self.random_seed < -1:
            out.append("random_seed must be -1 or more")
        return out

    def checked(self) -> ReconConfig:
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self
