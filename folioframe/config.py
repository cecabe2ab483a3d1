"""Options of the operators, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class AdaptiveThresholds:
    """method: otsu, histogram, dynamic; anything else falls back to fixed thresholds."""

    enabled: bool = False
    method: str = "histogram"
    min_db: float = 0.1
    max_db: float = 0.8
    min_box: float = 0.3
    max_box: float = 0.9
    otsu_multiplier: float = 1.0


@dataclass(frozen=True)
class Morphology:
    """operation: none, dilate, erode, opening, closing, smooth."""

    operation: str = "none"
    kernel: int = 3
    iterations: int = 1


@dataclass(frozen=True)
class MultiScale:
    enabled: bool = False
    scales: tuple[float, ...] = (1.0, 0.75, 0.5)
    merge_iou: float = 0.3
    adaptive: bool = False
    max_levels: int = 3
    min_side: int = 320
    incremental: bool = True


@dataclass(frozen=True)
class Detector:
    """nms_method: hard, linear, gaussian. confidence: mean, max, mean_var; gamma 0 or 1 leaves it."""

    db_threshold: float = 0.3
    box_threshold: float = 0.5
    max_side: int = 960
    nms: bool = True
    nms_iou: float = 0.3
    nms_method: str = "hard"
    soft_sigma: float = 0.5
    soft_score: float = 0.1
    polygon: str = "minrect"
    adaptive_nms: bool = False
    adaptive_nms_scale: float = 1.0
    size_aware_nms: bool = False
    min_region_size: int = 32
    max_region_size: int = 1024
    size_scale: float = 0.1
    confidence: str = "mean"
    gamma: float = 0.0
    adaptive_confidence: bool = False
    adaptive_confidence_scale: float = 0.2
    thresholds: AdaptiveThresholds = field(default_factory=AdaptiveThresholds)
    morphology: Morphology = field(default_factory=Morphology)
    multi_scale: MultiScale = field(default_factory=MultiScale)


@dataclass(frozen=True)
class ImageConstraints:
    max_width: int = 1024
    max_height: int = 1024
    min_width: int = 32
    min_height: int = 32
    multiple: int = 32


@dataclass(frozen=True)
class Recognizer:
    """decode: greedy or beam. max_width 0: no limit."""

    height: int = 48
    max_width: int = 0
    pad_multiple: int = 8
    decode: str = "greedy"
    beam_width: int = 10
    blank: int = 0


@dataclass(frozen=True)
class CleanText:
    """form: NFC, NFKC, NFD, NFKD; empty is NFC, anything else none. replacements go before the language's own."""

    form: str = "NFC"
    collapse: bool = True
    trim: bool = True
    strip_control: bool = True
    strip_zero_width: bool = True
    language: str = ""
    replacements: tuple[tuple[str, str], ...] | None = None


@dataclass(frozen=True)
class Orientation:
    enabled: bool = False
    threshold: float = 0.7
    line_threshold: float = 0.6
    heuristic_fallback: bool = True
    skip_square: bool = True
    square_ratio: float = 1.2


@dataclass(frozen=True)
class Rectify:
    enabled: bool = False
    mask_threshold: float = 0.5
    out_height: int = 1024
    min_coverage: float = 0.05
    min_points: int = 100
    min_area: float = 0.20
    min_aspect: float = 0.2
    max_aspect: float = 8.0
    min_corner_distance: float = 0.05


@dataclass(frozen=True)
class PageAnalyzer:
    quality: float = 0.7
    coverage: float = 0.8
    hybrid: bool = True
    fallback: bool = True


@dataclass(frozen=True)
class Hybrid:
    """strategy: append, spatial, confidence, smart."""

    strategy: str = "smart"
    confidence: float = 0.5
    overlap: float = 0.1
    deduplicate: bool = True
    similarity: float = 0.8
    prefer_vector: bool = True
    min_ocr: float = 0.3


@dataclass(frozen=True)
class RateLimit:
    """A limit of 0 or less is none."""

    per_minute: int = 0
    per_hour: int = 0
    requests_per_day: int = 0
    bytes_per_day: int = 0
