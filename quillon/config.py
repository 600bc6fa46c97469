"""Declarative pipeline definitions (XML) as dataclasses."""

from __future__ import annotations

import warnings
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from pathlib import Path

from quillon.functions.metrics import OPERATIONS, nanoseconds


class ConfigError(ValueError):
    """The definition isn't valid."""


@dataclass
class Metric:
    """A single event (``a`` only) or a mix of two."""

    name: str
    a: str
    b: str | None = None
    operation: str = ""
    factor: float = 1.0
    low: float | None = None
    high: float | None = None
    log: bool = False


@dataclass
class Plot:
    x: str
    y: str
    z: str | None = None
    raw: bool = False


@dataclass
class Pipeline:
    """All of a definition; times are in ns (in the text in microseconds, unless they have a unit)."""

    use_duration: bool = False
    apply_log: bool = False
    normalize: bool = True
    duration_filter: int = 0
    threshold_filter: float = 0.0
    algorithm: str = ""
    arguments: dict[str, str] = field(default_factory=dict)
    clustering: list[Metric] = field(default_factory=list)
    extrapolation: list[Metric] = field(default_factory=list)
    all_counters: bool = False
    plots: list[Plot] = field(default_factory=list)
    all_plots: bool = False
    #: Bursts carry a semantic value that is the first clustering metric; a switch of the run, not of the definition.
    use_semantic: bool = False
    semantic_log: bool = False


def _flag(node: ET.Element, name: str, default: bool = False) -> bool:
    value = node.get(name)
    return default if value is None else value.strip().lower() == "yes"


def _text(node: ET.Element, name: str) -> str | None:
    child = node.find(name)
    return child.text.strip() if child is not None and child.text else None


def _bound(node: ET.Element, name: str) -> float | None:
    value = _text(node, name)
    if value is None or float(value) == -1:
        return None
    return float(value)


def _metric(node: ET.Element) -> Metric:
    common = {"factor": float(_text(node, "factor") or 1), "low": _bound(node, "range_min"), "high": _bound(node, "range_max"), "log": _flag(node, "apply_log")}
    name = node.get("name") or ""
    if node.tag == "single_event":
        a = _text(node, "event_type")
        if a is None:
            raise ConfigError("single_event without an event_type")
        return Metric(name or a, a, **common)
    a, b = _text(node, "event_type_a"), _text(node, "event_type_b")
    operation = (node.get("operation") or "")[:1]
    if a is None or b is None or operation not in OPERATIONS:
        raise ConfigError("mixed_events needs two event types and an operation")
    return Metric(name or f"{a}{operation}{b}", a, b, operation, **common)


def parse(text: str) -> Pipeline:
    """S16. Unknown nodes are errors, a repeated clustering metric too; a repeated extrapolation metric is left out with a warning."""
    root = ET.fromstring(text)
    out = Pipeline(_flag(root, "use_duration"), _flag(root, "apply_log"), _flag(root, "normalize_data", True), nanoseconds(root.get("duration_filter") or "0"), float(root.get("threshold_filter") or 0))
    if not 0 <= out.threshold_filter <= 100:
        raise ConfigError("threshold_filter is a percentage")
    for node in root:
        if node.tag == "clustering_algorithm":
            out.algorithm = node.get("name") or ""
            out.arguments = {c.tag: (c.text or "").strip() for c in node}
        elif node.tag in ("clustering_parameters", "extrapolation_parameters"):
            if node.tag.startswith("extra") and _flag(node, "all_counters"):
                out.all_counters = True
            own = out.clustering if node.tag.startswith("clus") else out.extrapolation
            for child in node:
                if child.tag not in ("single_event", "mixed_events"):
                    raise ConfigError(f"unknown node {child.tag}")
                metric = _metric(child)
                if any(m.name == metric.name for m in own):
                    if own is out.clustering:
                        raise ConfigError(f"repeated metric {metric.name}")
                    warnings.warn(f"repeated metric {metric.name} is left out", stacklevel=2)
                    continue
                own.append(metric)
        elif node.tag == "output_plots":
            out.all_plots = _flag(node, "all_plots")
            for child in node:
                if child.tag != "plot_definition":
                    raise ConfigError(f"unknown node {child.tag}")
                x, y = _text(child, "x_metric"), _text(child, "y_metric")
                if x is None or y is None:
                    raise ConfigError("a plot needs two metrics")
                out.plots.append(Plot(x, y, _text(child, "z_metric"), _flag(child, "raw_metrics")))
        else:
            raise ConfigError(f"unknown node {node.tag}")
    return out


def load(path: str) -> Pipeline:
    return parse(Path(path).read_text())
