"""Pipeline configuration: detectors, thresholds, watchlists and strings.

The values in the block marked FIXED must equal the behaviour being
reproduced; everything else is a default of this engine.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED values (they decide results, so they are stated plainly here).
# ---------------------------------------------------------------------------
OBJECT_SAMPLE_RATE = 5
FIREARM_SAMPLE_RATE = 5
FEATURE_SAMPLE_RATE = 15
ACTIVITY_SEQUENCE_LENGTH = 4
ACTIVITY_THRESHOLD = 0.99
EVENT_TOP_COUNT = 3
OBJECT_THRESHOLD = 0.25
FIREARM_THRESHOLD = 0.54
ABNORMAL_ACTIVITY = "Abnormal Activity"
NORMAL_ACTIVITY = "Normal Activity"
SUSPICIOUS_OBJECTS = ["pistol", "knife"]
SUSPICIOUS_EVENTS = [
    "Parade", "People_Marching", "Riot", "Raid", " Traffic", "Car_Racin",
    "Car_Accident", "Soldier_Firing", "Soldier_Patrol", "Soldier_Drilling",
    "Street_Battle",
]
FRESHNESS_SECONDS = 5
SECONDS_PER_DAY = 86400
DEFAULT_COLOUR = (255.0, 0.0, 0.0)
CAPTION_OFFSET_Y = 13
FONT_SCALE_PER_PIXEL = 1e-3
BOX_LINE_WIDTH = 1
SUMMARY_LINE_FORMAT = "{label} ({count})\n"
FRAME_TOPIC = "test"
RESULT_TOPIC = "resultstream"
BATCH_INTERVAL = "1 second"
# Wire format of the frame time stamp; the fraction is absent when it is 0.
EVENT_TIME_PATTERN = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
# ---------------------------------------------------------------------------

# Engine defaults (not behaviour of the original pipeline).
# Rows per chunk for ordered scans: a hot camera is cut into chunks of this
# many consecutive frames so no single task holds a whole camera.
SCAN_CHUNK_ROWS = 1 << 20
# The same for rolling windows of feature vectors (2,048 doubles are 16 kB).
VECTOR_CHUNK_ROWS = 1 << 14
# Session setting that overrides the value above.
CHUNK_ROWS_CONF = "spark.sightline.scan.chunkRows"
# Cameras whose newest frame and state are broadcast to the frames of a
# micro-batch; more are joined by shuffle.
BROADCAST_CAMERAS = 200_000
# Rows whose places are broadcast at a time when their images are fetched
# late; more are fetched in rounds.
FETCH_ROWS = 1_000_000


def session_int(spark, key: str, default: int) -> int:
    """An integer engine setting from the session conf, else the default."""
    v = spark.conf.get(key, None)
    return int(v) if v not in (None, "") else default


@dataclass(frozen=True)
class Detector:
    name: str
    rate: int
    threshold: float | None = None
    enabled: bool = True
    # Detectors whose input is produced by this one (feature -> event/activity).
    needed_by: tuple[str, ...] = ()

    def __post_init__(self):
        if self.rate < 1:
            raise ValueError(f"sample rate of {self.name} must be >= 1, got {self.rate}")


@dataclass(frozen=True)
class PipelineConfig:
    detectors: tuple[Detector, ...] = field(default_factory=lambda: (
        Detector("object", OBJECT_SAMPLE_RATE, OBJECT_THRESHOLD),
        Detector("firearm", FIREARM_SAMPLE_RATE, FIREARM_THRESHOLD),
        Detector("feature", FEATURE_SAMPLE_RATE, None, True, ("event", "activity")),
    ))
    event_enabled: bool = False
    activity_enabled: bool = False
    watchlist: tuple[str, ...] = tuple(SUSPICIOUS_OBJECTS)
    freshness_seconds: int = FRESHNESS_SECONDS

    def active_detectors(self) -> list[Detector]:
        """Detectors that run: enabled ones, and the feature extractor only
        while some consumer of its output is on."""
        on = {"event": self.event_enabled, "activity": self.activity_enabled}
        out = []
        for d in self.detectors:
            if d.needed_by:
                if d.enabled and any(on.get(n, False) for n in d.needed_by):
                    out.append(d)
            elif d.enabled:
                out.append(d)
        return out

    def sample_lcm(self) -> int:
        rates = [d.rate for d in self.detectors]
        return math.lcm(*rates) if rates else 1

    def thresholds(self) -> dict[str, float]:
        return {d.name: d.threshold for d in self.detectors if d.threshold is not None}


DEFAULT_CONFIG = PipelineConfig()
