"""Options of a run, as frozen dataclasses, and presets."""

from __future__ import annotations

from dataclasses import dataclass, replace

from turbula.operators.bootstrap_lag import Bootstrap

# The choices that each option has.
CHOICES = {
    "detrend": ("ba", "ld", "rm", "ew"),
    "rotation": ("none", "double_rotation", "triple_rotation", "planar_fit", "planar_fit_no_bias"),
    "lag": ("none", "constant", "maxcov", "maxcov&default", "pwb"),
    "despike": ("none", "median", "moving"),
    "taper": ("squared", "bartlett", "welch", "hamming", "hann"),
    "high_frequency": ("none", "moncrieff_97", "horst_97", "ibrom_07", "massman_00"),
    "path": ("open", "closed"),
    "footprint": ("none", "kljun_04", "kormann_meixner_01", "hsieh_00"),
    "flags": ("none", "mauder_foken_04", "foken_03", "goeckede_06"),
    "uncertainty": ("none", "finkelstein_sims_01", "mann_lenschow_94", "mahrt_98", "billesbach_11"),
}


@dataclass(frozen=True)
class Run:
    """Raw processing of one site."""

    minutes: int = 30
    hertz: float = 10.0
    height: float = 3.0
    displacement: float = 0.0
    roughness: float = 0.1
    altitude: float = 0.0
    latitude: float = 45.0
    pressure: float | None = None  # Pa; without it, that of the altitude
    detrend: str = "ba"
    time_constant: float = 250.0
    rotation: str = "double_rotation"
    sectors: int = 1  # of the wind, each with a plane of its own; one without borrows its neighbour's
    lag: str = "maxcov&default"
    lag_range: tuple[int, int] = (-10, 10)
    default_lag: int = 0
    bootstrap: Bootstrap = Bootstrap()  # of the lag option pwb
    instruments: dict | None = None  # model by gas; pwb shares lags within one
    despike: str = "none"
    max_missing_percent: float = 10.0
    taper: str = "hamming"
    high_frequency: str = "none"
    density_terms: bool = True
    path: str = "open"
    cell_pressure: float | None = None  # Pa, of a closed path; without it, the air's
    self_heating: dict | None = None  # of an open path: slope and intercept of each surface's temperature
    footprint: str = "none"
    flags: str = "mauder_foken_04"
    uncertainty: str = "none"
    sensor_tau: float = 0.1
    ibrom: tuple[float, float] | None = None  # fitted parameters of the in-situ method
    cutoff: float | None = None  # Hz, fitted

    limits: dict | None = None  # absolute limits by column

    def __post_init__(self):
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if self.high_frequency == "ibrom_07" and (self.ibrom is None or self.cutoff is None):
            raise ValueError("ibrom_07 needs fitted parameters (ibrom) and a cut-off frequency (cutoff)")


# Absolute limits of the express preset.
EXPRESS_LIMITS = {"u": (-30.0, 30.0), "v": (-30.0, 30.0), "w": (-5.0, 5.0), "ts": (233.15, 323.15), "co2": (200.0, 900.0), "h2o": (0.0, 40.0)}


def express(**changes) -> Run:
    """Defaults for a first look: limits of the wind and the sonic temperature, block average, double rotation, largest covariance, model corrections."""
    limits = {c: EXPRESS_LIMITS[c] for c in ("u", "v", "w", "ts")}
    return replace(Run(despike="moving", high_frequency="moncrieff_97", footprint="kljun_04", limits=limits), **changes)
