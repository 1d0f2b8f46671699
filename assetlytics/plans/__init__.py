"""Importing this package registers every query module."""

from . import q_basic, q_eval, q_features, q_kpi, q_linear, q_models, q_prep, q_profile, q_scoring, q_stream  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
