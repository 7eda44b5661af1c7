"""Bindings of every operator to the shared test tables, with their SQL."""

from . import consolidate, context, evaluate, prepare, retrieve, rows, text, traindata  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
from .retrieve import flagship  # noqa: F401
