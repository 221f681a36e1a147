"""glossmill: a PySpark-native engine for building, labelling and scoring text corpora."""

from __future__ import annotations

__version__ = "0.1.0"
