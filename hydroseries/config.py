"""Parameters of the engine.

Every knob the feature, fill, scaling and scoring operators read lives here, as
plain dataclasses with the defaults the survey settles on.  Operators take a
config object as an argument; nothing reads module globals at call time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values (must equal the reference's for equal results) -----------
# Reference new moon: 2000-01-06 12:00:00 UTC, as epoch seconds.
LUNAR_REFERENCE_EPOCH_S = 947160000
# Synodic month in days, and the number of phases the cycle is cut into.
SYNODIC_MONTH_DAYS = 29.530588
LUNAR_PHASES = 8
# Flood level threshold (metres) and the level floor (metres).
FLOOD_WATER_LEVEL_THRESHOLD_M = 1.5
LEVEL_FLOOR_M = 0.05
# Rain and soil thresholds named for the composite flood flag.
RAIN_THRESHOLD_FOR_FLOOD_MM_HR = 20.0
SOIL_MOISTURE_FLOOD_THRESHOLD = 0.45
# Cloud percentage limit (strict <) and the QA60 cloud / cirrus bits.
CLOUD_PCT_LIMIT = 20.0
QA_CLOUD_BITS = (10, 11)
# Pixel scale in metres; the reference clips to a buffer of 2 x scale.
PIXEL_SCALE_M = 30.0
RAINFALL_BAND = "precipitationCal"
SOIL_MOISTURE_BAND = "sm_rootzone_depth"
# Harmonic baselines: (period, amplitude, offset).
TIDE_HARMONIC = (12.42, 0.5, 1.0)      # hours
DAILY_HARMONIC = (24.0, 0.3, 0.8)      # hours
SEASONAL_HARMONIC = (365.0, 0.2, 0.8)  # days of year
# Rainy season months, inclusive.
RAINY_SEASON_MONTHS = (5, 10)
# Raw feature names of the source tables.
FEATURES = (
    "temperature", "humidity", "pressure", "wind_speed", "rain_1h",
    "sea_level_m", "local_water_level_m",
    "satellite_rainfall_mm_hr",
    "satellite_water_index_s1_vv",
    "satellite_water_index_s2_ndwi",
    "satellite_soil_moisture",
)
# Name substrings that mark a column as a continuous sensor (interpolated),
# and the substrings of the columns whose remaining nulls become 0.0.
CONTINUOUS_NAME_PARTS = (
    "rain", "level", "temperature", "humidity", "pressure", "wind",
    "satellite", "soil_moisture",
)
RAIN_NAME_PARTS = ("rain", "satellite_rainfall")
# Substrings of the columns whose nulls drop a feature row.
INCOMPLETE_NAME_PARTS = ("_lag_", "_sum_", "_avg_", "_std_")
# Prediction messages and the short-history message (two integers: needed, got).
MSG_FLOOD = "Flood predicted for next hour."
MSG_NO_FLOOD = "No flood predicted for next hour."
MSG_HIGH_LEVEL = "High water level predicted for next hour."
MSG_NORMAL_LEVEL = "Normal water level predicted for next hour."
MSG_SHORT_HISTORY = "Not enough real-time data in window. Need at least %d hours, got %d."
# ---------------------------------------------------------------------------

TARGET_REGRESSION = "water_level_next_1h"
TARGET_CLASSIFICATION = "is_flood_next_1h"
ALL_TARGET_COLUMNS = (TARGET_REGRESSION, TARGET_CLASSIFICATION)


@dataclass(frozen=True)
class SeriesSpec:
    """How a table of hourly series is keyed.

    ``chunk_hours`` cuts each series into fixed, epoch-aligned chunks of that
    many hours.  Window operators partition by ``keys + chunk`` instead of by
    ``keys`` alone, so one very long (or very hot) series is spread over many
    tasks; bounded frames copy a small halo from the neighbouring chunks and
    unbounded fills carry values across chunks through a small chunk table.
    ``chunk_hours=None`` partitions by the keys alone.
    """

    keys: tuple[str, ...] = ("site_id",)
    ts: str = "ts"
    chunk_hours: int | None = 2688  # sixteen weeks (measured: fewer, larger window groups win)

    def with_chunk(self, chunk_hours: int | None) -> "SeriesSpec":
        return SeriesSpec(self.keys, self.ts, chunk_hours)


@dataclass(frozen=True)
class FeatureConfig:
    """Parameters of the feature builder (defaults of the survey, section 0.2)."""

    lag_features: tuple[str, ...] = ("rain_1h", "local_water_level_m", "sea_level_m")
    lag_depth: int = 24
    rolling_windows: tuple[int, ...] = (3, 6, 12, 24)
    rainfall_columns: tuple[str, ...] = ("rain_1h", "satellite_rainfall_mm_hr")
    level_columns: tuple[str, ...] = ("local_water_level_m",)
    target_level_column: str = "local_water_level_m"
    horizon_hours: int = 1
    flood_threshold_m: float = FLOOD_WATER_LEVEL_THRESHOLD_M
    interaction_pairs: tuple[tuple[str, str, str], ...] = (
        ("rain_1h", "humidity", "rain_x_humidity"),
    )
    static_columns: tuple[str, ...] = ("elevation_m",)
    tz: str = "Asia/Bangkok"
    # Parity switch: the reference also requires the regression target when
    # dropping incomplete rows, which removes the newest hour from scoring.
    require_target: bool = True
    # If a lag feature or the level column is absent the reference silently
    # returns an empty table; we raise unless parity is asked for.
    strict_columns: bool = True

    @property
    def history_rows_needed(self) -> int:
        widest = max(self.rolling_windows) if self.rolling_windows else 0
        return max(self.lag_depth, widest) + self.horizon_hours


@dataclass(frozen=True)
class TrainConfig:
    test_ratio: float = 0.2
    validation_ratio: float = 0.2
    classification_threshold: float = 0.5
    max_iter: int = 100
    max_depth: int = 5
    step_size: float = 0.1
    seed: int = 42
    # 'train' fits the scaler on the training rows only; 'all' reproduces the
    # reference, which fits on every row before the split.
    scaler_fit_on: str = "train"
    # Linear learners: the penalties tried; the one with the least loss on the
    # validation rows is kept (a single one is not validated).
    reg_params: tuple[float, ...] = (0.0,)
    tolerance: float = 1e-6


@dataclass(frozen=True)
class EngineConfig:
    series: SeriesSpec = field(default_factory=SeriesSpec)
    features: FeatureConfig = field(default_factory=FeatureConfig)
    train: TrainConfig = field(default_factory=TrainConfig)
