"""Detectors of issues, built in and custom."""

from __future__ import annotations

import importlib
import logging
import pkgutil
from abc import ABC, abstractmethod
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import flag
from ..schema import flag_column, score_column

log = logging.getLogger(__name__)


class Detector(ABC):
    """Finds one issue type.

    ``transform`` takes rows of image_id, ord, name and image and the merged
    parameters, and returns image_id, ``<type>_score`` (0 worst to 1) and
    ``is_<type>_issue``, and whatever other columns are of interest.
    """

    #: ``individual_images`` or ``image_sets``: how a report shows the issue.
    visualization = "individual_images"

    @abstractmethod
    def default_params(self) -> dict[str, Any]: ...

    @abstractmethod
    def transform(self, images: DataFrame, params: dict[str, Any]) -> DataFrame: ...

    def params(self, given: dict[str, Any] | None) -> dict[str, Any]:
        """Defaults overlaid by the given values that are not None; unknown names and other types raise."""
        out = self.default_params()
        for name, value in (given or {}).items():
            if name not in out:
                raise ValueError(f"{type(self).__name__} has no parameter {name!r}; it has {sorted(out)}")
            if value is None:
                continue
            usual = out[name]
            number = isinstance(usual, int | float) and not isinstance(usual, bool)
            fits = isinstance(value, int | float) and not isinstance(value, bool) if number else usual is None or isinstance(value, type(usual))
            if not fits:
                raise ValueError(f"{name} of {type(self).__name__} must be of type {type(usual).__name__}, not {type(value).__name__}")
            out[name] = value
        return out


class PixelDetector(Detector):
    """Scores one number that ``kernel`` takes from the pixels, in the pass that decodes each image once for all."""

    @abstractmethod
    def kernel(self, image: np.ndarray) -> float | None:
        """Of (height, width) or (height, width, channels) uint8 pixels, channels R, G, B, A."""

    def score(self, value: Column, params: dict[str, Any]) -> Column:
        """0 is worst, 1 is fine; the value itself unless overridden."""
        return value

    def default_params(self) -> dict[str, Any]:
        return {"threshold": 0.5}

    def scored(self, properties: DataFrame, issue: str, params: dict[str, Any]) -> DataFrame:
        """The columns of ``transform`` from a table that has the kernel's values; null values have no flag."""
        score = self.score(F.col(value_column(issue)), params)
        return properties.select("image_id", value_column(issue), score.alias(score_column(issue)), flag(score, params["threshold"]).alias(flag_column(issue)))

    def transform(self, images: DataFrame, params: dict[str, Any]) -> DataFrame:
        raise NotImplementedError("the audit computes kernels in its shared pass")


def value_column(issue: str) -> str:
    """Where the values of a ``PixelDetector`` stand among the properties."""
    return f"{issue}_value"


_DETECTORS: dict[str, type[Detector]] = {}


def register_detector(name: str):
    """Class decorator. A name that is taken keeps its first class."""

    def register(cls: type[Detector]) -> type[Detector]:
        if not (isinstance(cls, type) and issubclass(cls, Detector)):
            raise ValueError(f"{cls!r} is no subclass of Detector")
        if name in _DETECTORS:
            log.warning("%s is registered already; the first class stays", name)
        return _DETECTORS.setdefault(name, cls)

    return register


def detector(name: str) -> Detector:
    if not isinstance(name, str):
        raise ValueError("one issue type is expected, not a list")
    if name not in _DETECTORS:
        raise KeyError(f"{name!r} is no registered issue type")
    return _DETECTORS[name]()


def detectors(names: list[str]) -> list[Detector]:
    return [detector(n) for n in names]


def registered() -> list[str]:
    return sorted(_DETECTORS)


def load_detectors(package: str) -> list[str]:
    """Import all modules of a package, so that the detectors in them register; returns the new names."""
    before = set(_DETECTORS)
    found = importlib.import_module(package)
    for module in pkgutil.iter_modules(getattr(found, "__path__", [])):
        if not module.name.startswith("_"):
            importlib.import_module(f"{package}.{module.name}")
    return sorted(set(_DETECTORS) - before)
