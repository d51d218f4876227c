"""Audits that follow a growing folder."""

from .incremental import image_stream, property_stream, score_stream, store_properties

__all__ = ["image_stream", "property_stream", "score_stream", "store_properties"]
