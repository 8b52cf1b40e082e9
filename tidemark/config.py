"""Research settings: themes, providers, rebalance schedules and strategy thresholds.

Everything here is reference data of a few dozen rows; the operators turn it into literals.
"""

from __future__ import annotations

# Theme -> (keywords, fund tickers, watched symbols).
THEMES: dict[str, dict[str, list[str]]] = {
    "uranium": {
        "keywords": ["uranium", "nuclear fuel", "U3O8", "yellowcake"],
        "products": ["URNM", "URNJ", "ATOM", "NLR", "URA"],
        "watch": ["PDN.AX", "BOE.AX", "DYL.AX", "PEN.AX", "LOT.AX", "BMN.AX", "AGE.AX", "NXG.AX"],
    },
    "rare_earths_strategic_metals": {
        "keywords": ["rare earth", "neodymium", "praseodymium", "strategic metals", "critical minerals"],
        "products": ["REMX", "MVRARE", "ARE"],
        "watch": ["LYC.AX", "ILU.AX", "ARU.AX", "HAS.AX", "LTR.AX", "MEI.AX"],
    },
    "gold_miners": {
        "keywords": ["gold miners", "gold mining"],
        "products": ["GDX", "GDXJ", "MNRS"],
        "watch": ["NST.AX", "EVN.AX", "NEM.AX", "GMD.AX", "RMS.AX", "PRU.AX", "RRL.AX", "CMM.AX"],
    },
    "battery_metals_lithium": {
        "keywords": ["lithium", "battery metals", "cobalt", "graphite", "anode"],
        "products": ["LIT", "ACDC", "BATT"],
        "watch": ["PLS.AX", "MIN.AX", "IGO.AX", "LTR.AX", "AKE.AX", "SYR.AX"],
    },
    "copper": {
        "keywords": ["copper miners"],
        "products": ["COPX", "WIRE"],
        "watch": ["SFR.AX", "29M.AX", "CMM.AX", "AIS.AX"],
    },
    "defence": {
        "keywords": ["defence", "defense", "aerospace", "military"],
        "products": ["ARMR", "SHLD", "DFEN"],
        "watch": ["DRO.AX", "EOS.AX", "ASB.AX", "BAB.AX"],
    },
    "clean_energy_solar_wind_hydrogen": {
        "keywords": ["clean energy", "solar", "wind", "hydrogen", "renewables"],
        "products": ["ICLN", "TAN", "FAN", "HJEN", "HGEN"],
        "watch": ["NHC.AX", "ORG.AX", "IFT.AX"],
    },
    "robotics_ai": {
        "keywords": ["robotics", "artificial intelligence", "automation"],
        "products": ["BOTZ", "ROBO", "RBTZ", "ARKQ"],
        "watch": ["BRN.AX", "WTC.AX", "APX.AX"],
    },
    "cybersecurity": {
        "keywords": ["cyber security", "cybersecurity"],
        "products": ["BUG", "HACK", "CIBR"],
        "watch": ["TNE.AX", "DSE.AX"],
    },
    "agriculture_food_water": {
        "keywords": ["agriculture", "farming", "food", "water"],
        "products": ["FOOD", "MOO", "PHO", "CIBO"],
        "watch": ["GNC.AX", "ELD.AX", "NUF.AX", "AAC.AX", "IPL.AX"],
    },
    "semiconductors": {
        "keywords": ["semiconductor", "chips"],
        "products": ["SOXX", "SMH", "SEMI"],
        "watch": ["BRN.AX", "4DS.AX", "RFX.AX"],
    },
    "space": {
        "keywords": ["space", "satellite"],
        "products": ["UFO", "ARKX"],
        "watch": ["DRO.AX", "EOS.AX"],
    },
    "biotech_healthcare": {
        "keywords": ["biotech", "healthcare", "genomics"],
        "products": ["XBI", "IBB", "ARKG"],
        "watch": ["CSL.AX", "PME.AX", "TLX.AX", "CUV.AX", "NEU.AX", "MSB.AX"],
    },
}

# Rebalance schedules (fund, months, rule, lead days).
SCHEDULES: list[tuple[str, list[int], str, int]] = [
    ("URNJ", [6, 12], "3rd_friday", 6),
    ("URNM", [3, 6, 9, 12], "3rd_friday", 6),
    ("URA", [2, 8], "month_start", 7),
    ("NLR", [3, 6, 9, 12], "3rd_friday", 5),
    ("GDXJ", [3, 6, 9, 12], "3rd_friday", 5),
    ("GDX", [3, 6, 9, 12], "3rd_friday", 5),
    ("REMX", [3, 6, 9, 12], "3rd_friday", 5),
    ("LIT", [2, 8], "month_start", 7),
    ("COPX", [5, 11], "month_start", 7),
    ("ISO.AX", [3, 6, 9, 12], "3rd_friday", 14),
    ("MVS.AX", [3, 9], "3rd_friday", 5),
]

# Thresholds and exits per strategy.
STRATEGY_PARAMS: dict[str, dict] = {
    "DelayedAnnouncementReaction": {
        "enabled": True,
        "max_immediate_reaction_pct": 0.03,
        "min_flow_pressure": 0.5,
        "min_confidence": 0.4,
        "entry": "next_open",
        "exit": "effective_open",
        "max_hold_days": 25,
    },
    "HighFlowLowLiquidity": {
        "enabled": True,
        "min_flow_pressure": 1.0,
        "max_adv_dollars": 2_000_000.0,
        "entry": "next_open",
        "exit": "eff_close_plus3",
    },
    "HoldingsDiffSignal": {
        "enabled": True,
        "min_new_weight_pct": 0.001,
        "max_immediate_reaction_pct": 0.04,
        "entry": "detected_next_open",
        "exit": "plus5",
    },
    "MethodologyChangeAnticipation": {
        "enabled": False,
        "entry": "next_open",
        "exit": "eff_close_plus5",
    },
    "ThematicIndexPrediction": {"enabled": False},
    "RebalanceCalendarTrade": {"enabled": False, "min_confidence": 0.7},
    "EffectiveDateFade": {"enabled": False},
    "MultiETFStackedFlow": {
        "enabled": True,
        "min_products": 2,
        "window_days": 30,
        "entry": "next_open",
        "exit": "eff_close_plus5",
    },
    "ForgottenSmallCapAdd": {
        "enabled": True,
        "max_adv_dollars": 1_000_000.0,
        "max_market_cap": 500_000_000.0,
        "max_immediate_reaction_pct": 0.02,
        "min_flow_pressure": 0.75,
        "min_source_obscurity": 0.5,
        "entry": "next_open",
        "exit": "eff_close_plus10",
    },
}
