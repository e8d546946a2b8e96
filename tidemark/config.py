"""Constants and options of the timeline pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Grid:
    """A sliding window: the i-th position covers start + i * step, for duration seconds."""

    step: float
    duration: float
    start: float = 0.0
    end: float | None = None

    def __post_init__(self) -> None:
        if self.duration <= 0 or self.step <= 0:
            raise ValueError("duration and step must be positive")
        if self.end is not None and self.end <= self.start:
            raise ValueError("end must lie after start")


@dataclass(frozen=True)
class Chunks:
    """Chunks of a sequence, in samples; frames and classes that a scorer gives for one."""

    window: int = 80_000
    step: int = 8_000
    rate: int = 16_000
    frames: int = 293
    classes: int = 3

    def __post_init__(self) -> None:
        if self.window < self.step or self.step <= 0 or self.window % self.step:
            raise ValueError("the window must be a multiple of the step")


FRAME = Grid(step=0.016875, duration=0.016875)
CHUNK = Grid(step=0.5, duration=5.0)
PRECISION = 1e-6


@dataclass(frozen=True)
class Thresholds:
    """Of scores to activity, of activity to intervals, and of intervals to the timeline."""

    onset: float = 0.4442333667381752
    offset: float = 0.4442333667381752
    final_onset: float = 0.5
    final_offset: float = 0.5
    min_duration_on: float = 0.0
    min_duration_off: float = 0.5817029604921046
    min_samples: int = 640
    trim: tuple[float, float] = (0.1, 0.1)


@dataclass(frozen=True)
class ClusterOptions:
    """Of the agglomerative clustering."""

    threshold: float = 0.7153814381597874
    method: str = "centroid"
    min_cluster_size: int = 15
    num_clusters: int | None = None
    min_clusters: int | None = None
    max_clusters: int | None = None
    max_embeddings: int | None = None
    constrained: bool = False
    centroid_space: str = "normalised"
    batch32: bool = False


@dataclass(frozen=True)
class Options:
    """All of the above."""

    chunks: Chunks = field(default_factory=Chunks)
    thresholds: Thresholds = field(default_factory=Thresholds)
    clustering: ClusterOptions = field(default_factory=ClusterOptions)
