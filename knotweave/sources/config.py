"""Defaults that change results, prompt labels, and which project a call means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Defaults of retrieval and indexing.
DEFAULTS = {
    "window_words": 320,
    "overlap_ratio": 0.20,
    "embedder": "hash",
    "dim": 256,
    "hybrid": True,
    "rerank": True,
    "rerank_top_n": 20,
    "keyword_labels": [],
    "keyword_weight": 0.3,
    "summary_labels": ["summary", "asks"],
    "summary_weight": 1.0,
    "coverage_gate": False,
    "bulk_max_sections": 10,
}


def settings(overrides: dict | None = None) -> dict:
    """Defaults with overrides; an unknown name is an error."""
    unknown = set(overrides or {}) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return DEFAULTS | (overrides or {})


def labels(built_in: DataFrame, configured: DataFrame) -> DataFrame:
    """``label prompt``: configured prompts before built-in ones."""
    kept = built_in.join(configured.select("label"), "label", "left_anti")
    return configured.select("label", "prompt").unionByName(kept.select("label", "prompt"))


def project_of(explicit: Column, session: Column, seed: Column, default: Column) -> Column:
    """The project that a call means: named, else the session's, else the nearest marker's, else the default."""
    blank = lambda c: F.when(c != "", c)
    return F.coalesce(*(blank(c) for c in (explicit, session, seed, default)))


def nearest_marker(paths: DataFrame, markers: DataFrame) -> DataFrame:
    """Paths with the ``project`` of the marker (``root project``) nearest above them."""
    from knotweave.operators.resolve import longest_prefix

    return longest_prefix(paths, markers.select("root", "project"))
