"""All options of a reading plan in one place: from mappings, checked, changed step by step, and run."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

from pyspark.sql import DataFrame

from ..config import CleanText, Detector, Hybrid, ImageConstraints, Orientation, PageAnalyzer, RateLimit, Recognizer, Rectify
from ..operators import limits
from . import documents, reading

#: Options that are shares, and those that are one of a few words.
SHARES = {
    "detector": ("db_threshold", "box_threshold", "nms_iou", "adaptive_nms_scale", "size_scale", "soft_score"),
    "detector.multi_scale": ("merge_iou",),
    "orientation": ("threshold", "line_threshold"),
    "rectify": ("mask_threshold", "min_coverage", "min_area"),
    "pages": ("quality", "coverage"),
    "hybrid": ("confidence", "overlap", "similarity", "min_ocr"),
}
WORDS = {
    ("detector", "polygon"): ("minrect", "contour"),
    ("detector", "nms_method"): ("hard", "linear", "gaussian"),
    ("detector", "confidence"): ("mean", "max", "mean_var"),
    ("detector.morphology", "operation"): ("none", "dilate", "erode", "opening", "closing", "smooth"),
    ("recognizer", "decode"): ("greedy", "beam"),
    ("hybrid", "strategy"): ("append", "spatial", "confidence", "smart"),
}


@dataclass(frozen=True)
class Options:
    images: ImageConstraints = field(default_factory=ImageConstraints)
    detector: Detector = field(default_factory=Detector)
    recognizer: Recognizer = field(default_factory=Recognizer)
    text: CleanText = field(default_factory=CleanText)
    orientation: Orientation = field(default_factory=Orientation)
    rectify: Rectify = field(default_factory=Rectify)
    pages: PageAnalyzer = field(default_factory=PageAnalyzer)
    hybrid: Hybrid = field(default_factory=Hybrid)
    limits: RateLimit = field(default_factory=RateLimit)

    def part(self, path: str) -> Any:
        found: Any = self
        for name in path.split("."):
            found = getattr(found, name)
        return found

    def problems(self) -> list[str]:
        """What is wrong with the options, in words; none if they can be used."""
        out = [f"{p}.{n} must lie between 0 and 1" for p, names in SHARES.items() for n in names if not 0 <= getattr(self.part(p), n) <= 1]
        out += [f"{p}.{n} must be one of {', '.join(words)}" for (p, n), words in WORDS.items() if getattr(self.part(p), n) not in words]
        d = self.detector
        if d.min_region_size <= 0 or d.max_region_size < d.min_region_size:
            out.append("detector.min_region_size must be positive and no more than max_region_size")
        if d.multi_scale.max_levels < 0 or d.multi_scale.min_side < 0:
            out.append("detector.multi_scale.max_levels and min_side must not be negative")
        if self.recognizer.height <= 0 or self.recognizer.beam_width <= 0:
            out.append("recognizer.height and beam_width must be positive")
        return out


def _merged(part: Any, values: Mapping[str, Any], path: str = "") -> Any:
    known, changed = {f.name for f in fields(part)}, {}
    for name, value in values.items():
        if name not in known:
            raise ValueError(f"no option {path}{name}")
        old = getattr(part, name)
        if is_dataclass(old) and isinstance(value, Mapping):
            value = _merged(old, value, f"{path}{name}.")
        changed[name] = tuple(value) if isinstance(old, tuple) and isinstance(value, list) else value
    return replace(part, **changed)


def options(values: Mapping[str, Any] | None = None) -> Options:
    """Options from nested mappings, as a JSON or YAML file holds them; unknown names and bad values raise ValueError."""
    found = _merged(Options(), values or {})
    if wrong := found.problems():
        raise ValueError("; ".join(wrong))
    return found


class Reader:
    """Options set step by step: each ``with_`` gives a new reader; ``run`` is the plan that they describe."""

    def __init__(self, chosen: Options | None = None):
        self.options = chosen or Options()

    def _with(self, part: str, values: Mapping[str, Any]) -> Reader:
        return Reader(_merged(self.options, {part: values}))

    def with_images(self, **values: Any) -> Reader:
        return self._with("images", values)

    def with_detector(self, **values: Any) -> Reader:
        return self._with("detector", values)

    def with_recognizer(self, **values: Any) -> Reader:
        return self._with("recognizer", values)

    def with_text(self, **values: Any) -> Reader:
        return self._with("text", values)

    def with_orientation(self, **values: Any) -> Reader:
        return self._with("orientation", values)

    def with_rectify(self, **values: Any) -> Reader:
        return self._with("rectify", values)

    def with_pages(self, **values: Any) -> Reader:
        return self._with("pages", values)

    def with_hybrid(self, **values: Any) -> Reader:
        return self._with("hybrid", values)

    def with_limits(self, **values: Any) -> Reader:
        return self._with("limits", values)

    def run(self, maps: DataFrame, width: int, height: int, recognise: Callable[[DataFrame], DataFrame], dictionary: DataFrame, maps_at: Callable[[float], tuple[DataFrame, int, int]] | None = None) -> DataFrame:
        """The results of :func:`reading.results` under these options, which are checked first."""
        if wrong := self.options.problems():
            raise ValueError("; ".join(wrong))
        o = self.options
        return reading.results(maps, width, height, recognise, dictionary, o.detector, o.recognizer, o.text, maps_at)

    def run_pages(self, pages: DataFrame, images: DataFrame, detect: Callable[[DataFrame], DataFrame], recognise: Callable[[DataFrame], DataFrame], dictionary: DataFrame, map_w: int, map_h: int, texts: DataFrame | None = None, **models: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The results of :func:`documents.processed` under these options; ``models`` may be ``classify`` and ``masks``."""
        if wrong := self.options.problems():
            raise ValueError("; ".join(wrong))
        return documents.processed(pages, images, detect, recognise, dictionary, map_w, map_h, self.options, texts=texts, **models)

    def admitted(self, requests: DataFrame) -> DataFrame:
        """The requests that the limits let pass, with all their columns."""
        return limits.replay(requests, self.options.limits).filter("verdict = 'ok'").drop("verdict", "wait_us")
