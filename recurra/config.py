"""Settings of the engine; every operator takes what it needs as a parameter."""

from __future__ import annotations

from dataclasses import dataclass

#: Added to denominators, as the fingerprint is defined with it.
EPS = 1e-10


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of windows, matching, clustering, scoring and alerts (fixed values of the domain)."""

    window: int = 60
    overlap: float = 0.5
    horizon: int = 20
    lookbacks: tuple[int, ...] = (5, 10, 20)
    top_n: int = 20
    min_similarity: float = 0.5
    weights: tuple[float, float, float] = (0.5, 0.3, 0.2)
    clusters: int = 5
    min_cluster: int = 3
    reversal: float = -0.02
    failure_drawdown: float = -0.05
    cycle_start: str = "2021-01-27"
    cycle_days: float = 147.0
    score_weights: tuple[float, ...] = (0.30, 0.25, 0.20, 0.15, 0.10)
    grades: tuple[tuple[str, int], ...] = (("A+", 93), ("A", 87), ("B+", 83), ("B", 75), ("C+", 67), ("C", 55), ("D", 40))
    min_confidence: float = 0.60
    max_price: float = 350.0
    small_prices: tuple[float, float] = (1.0, 15.0)
    cooldown_hours: int = 8
    risk_floor: float = 0.02
    risk_scale: float = 1.5
    days_back: int = 30

    def __post_init__(self) -> None:
        if not 20 <= self.window <= 200 or not 0 <= self.overlap <= 0.9 or not 1 <= self.top_n <= 100:
            raise ValueError("window 20 to 200, overlap 0 to 0.9, top_n 1 to 100")
        if not 1 <= self.days_back <= 1000:
            raise ValueError("days_back 1 to 1000")

    @property
    def bars_back(self) -> int:
        """Bars that an ingest takes of each series."""
        return self.days_back * 24

    @property
    def stride(self) -> int:
        return stride(self.window, self.overlap)


def stride(window: int, overlap: float) -> int:
    """Bars between window starts; the product is truncated as a float."""
    return max(1, int(window * (1 - overlap)))


def batch(tickers: list[str], top_n: int = 10) -> list[str]:
    """The instruments of a batch scan, checked: 1 to 50 of them, and at most 50 matches each."""
    if not 1 <= len(tickers) <= 50 or not 1 <= top_n <= 50:
        raise ValueError("1 to 50 tickers, top_n 1 to 50")
    return tickers
