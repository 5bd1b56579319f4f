"""Imports every catalogue module, so that ``CATALOG`` is complete."""

from packetlens.plans import detection, intelligence, traffic  # noqa: F401
from packetlens.plans.catalog import CATALOG

__all__ = ["CATALOG"]
