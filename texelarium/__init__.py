"""Texture conversion, validation and block compression as Spark DataFrames."""

from .ship import ensure_importable

__all__ = ["ensure_importable"]
