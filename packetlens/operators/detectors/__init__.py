"""Behavioural detectors. Importing this package registers the four built-in ones."""

from packetlens.operators.detectors import beacon, dns_tunnel, exfiltration, port_scan  # noqa: F401
from packetlens.operators.detectors.base import (
    Detector,
    detector_names,
    evaluate,
    finding_addresses,
    finding_records,
    get_detector,
    register,
    run_detectors,
    sort_findings,
)

__all__ = [
    "Detector",
    "detector_names",
    "evaluate",
    "finding_addresses",
    "finding_records",
    "get_detector",
    "register",
    "run_detectors",
    "sort_findings",
]
