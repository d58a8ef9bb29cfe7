"""Settings of the panel engine. Spans, windows, grids and seeds that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
DEFAULT_HORIZONS = (5, 10, 21, 42, 63, 126)
QUANTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
SEED = 20260812
HUBER_C = 1.345
MAD_SCALE = 1.4826
MODES = ("market_residual", "raw")
MARKET = "__MKT__"


@dataclass(frozen=True)
class PanelConfig:
    """Windows in rows of a series; horizons double as spectral spans."""

    horizons: tuple[int, ...] = DEFAULT_HORIZONS
    vol_span: int = 33
    demean: int = 252
    spectral_window: int = 756
    beta_window: int = 252
    stride: int = 5
    z_clip: float = 8.0
    min_history_frac: float = 0.67
    extra_history: int = 100

    @property
    def demean_min(self) -> int:
        return max(60, self.demean // 2)

    @property
    def beta_min(self) -> int:
        return max(40, self.beta_window // 2)

    @property
    def spectral_min(self) -> int:
        return max(100, int(self.spectral_window * self.min_history_frac))

    @property
    def min_rows(self) -> int:
        return self.spectral_window + max(self.horizons) + self.extra_history


#: Short windows for panels of a few thousand days.
SMALL = PanelConfig(horizons=(5, 10, 21), vol_span=21, demean=63, spectral_window=252, beta_window=63, stride=1)

#: The grids of a critical-horizon scan on such panels: the fine one has no gap and ends at the anchor, which is on the coarse one, too.
COARSE_GRID, FINE_GRID, ANCHOR = (10, 21, 28, 35, 45, 52, 59, 63), (41, 42, 43, 44, 45), 45
TAILS = PanelConfig(horizons=tuple(sorted({*COARSE_GRID, *FINE_GRID})), vol_span=21, demean=63, spectral_window=252, beta_window=63, stride=1)
