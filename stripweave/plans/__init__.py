"""Registered queries and their SQL oracles."""

from . import catalogue, configuration, geometry, incremental, matching, media
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalogue", "configuration", "geometry", "incremental", "matching", "media"]
