"""Audits of image collections on Spark."""

from .schema import VERSION as __version__

__all__ = ["ImageAudit", "Detector", "PixelDetector", "register_detector", "load_detectors", "__version__"]


def __getattr__(name: str):
    if name == "ImageAudit":
        from .plans.session import ImageAudit

        return ImageAudit
    if name in ("Detector", "PixelDetector", "register_detector", "load_detectors"):
        from .operators import registry

        return getattr(registry, name)
    raise AttributeError(name)
