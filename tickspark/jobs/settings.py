"""Settings that queries and their SQL share."""

from __future__ import annotations

import numpy as np

#: 2024-01-01 and 2024-01-31, UTC.
START_MS, END_MS = 1_704_067_200_000, 1_706_659_200_000
TIMEFRAME_S = 300
#: Steps, take profit, stop loss, fee and slippage in percent.
LABELS = (12, 0.35, 0.25, 0.04, 0.01)
SWEEP = [(h, tp, sl) for h in (3, 6, 12) for tp, sl in ((0.2, 0.2), (0.35, 0.25), (0.5, 0.3))]
#: A fixed linear scorer: coefficients of each class, and intercepts.
COEFFICIENTS = [{"ret_1s": 0.0}, {"ret_1s": -60.0, "ret_3s": 25.0, "trade_imbalance": 0.8}, {"ret_1s": 60.0, "ret_3s": -25.0, "trade_imbalance": -0.8}]
INTERCEPTS = [0.1, 0.0, -0.05]
#: Long and short threshold, margin.
THRESHOLDS = (0.36, 0.36, 0.01)
GRID = [(t, t, m) for t in (0.34, 0.38, 0.45, 0.9) for m in (0.0, 0.05)]


def mlp_weights() -> dict[str, np.ndarray]:
    """Seeded weights of two blocks of 16 over windows of 12 places, in place of exported ones."""
    rng = np.random.default_rng(5)
    layer = lambda i, a, b: {f"w{i}": rng.normal(size=(b, a)) / np.sqrt(a), f"b{i}": np.zeros(b)}
    norm = lambda i, b: {f"g{i}": np.ones(b), f"s{i}": np.zeros(b)}
    weights = layer("0a", 12, 16) | norm("0a", 16) | layer("0b", 16, 16) | norm("0b", 16) | layer("1a", 16, 16) | norm("1a", 16) | layer("1b", 16, 16) | norm("1b", 16)
    return weights | {f"h{k}": v for k, v in (layer("1", 16, 8) | layer("2", 8, 3)).items()}
