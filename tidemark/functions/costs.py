"""Transaction costs (SC16, SC17)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col


@dataclass(frozen=True)
class CostModel:
    """Basis points per side; participation is trade value over daily traded value."""

    brokerage_bps: float = 8.0
    half_spread_bps: float = 15.0
    slippage_bps: float = 10.0
    impact_coef: float = 0.10
    max_participation: float = 0.10
    harsh_multiplier: float = 2.0

    def breakdown(self, value: Column | str, adv: Column | str, harsh: bool = False) -> Column:
        """Struct of the cost components; everything NULL and capped without liquidity."""
        known = F.when(col(adv) > 0, col(adv).cast("double"))
        requested = col(value) / known
        participation = F.least(requested, F.lit(self.max_participation))
        stress = F.lit(self.harsh_multiplier if harsh else 1.0)
        impact = participation * F.lit(self.impact_coef * 10000.0)
        per_side = F.lit(self.brokerage_bps) + stress * (
            F.lit(self.half_spread_bps + self.slippage_bps) + impact
        )
        per_side = F.when(known.isNotNull(), per_side)
        return F.struct(
            F.when(known.isNotNull(), participation).alias("participation"),
            per_side.alias("per_side_bps"),
            (per_side * 2.0).alias("round_trip_bps"),
            F.when(known.isNotNull(), impact * stress).alias("impact_bps"),
            F.coalesce(requested > self.max_participation, F.lit(True)).alias("capped"),
            F.coalesce(F.when(known.isNotNull(), participation * known), F.lit(0.0)).alias(
                "executable_value"
            ),
        )

    def drift_hurdle(self) -> float:
        """Round-trip cost without impact, as a return."""
        return 2.0 * (self.brokerage_bps + self.half_spread_bps + self.slippage_bps) / 10000.0


def net_return(gross: Column | str, round_trip_bps: Column | str) -> Column:
    return col(gross) - col(round_trip_bps) / 10000.0
