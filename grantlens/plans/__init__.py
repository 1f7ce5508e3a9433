"""The named jobs. Importing the plan modules fills the registry."""

from __future__ import annotations

import importlib

MODULES = ("eligibility", "catalogues", "identity", "readiness", "questions", "documents", "extraction", "raster", "evaluation", "streams")


def all_jobs():
    for module in MODULES:
        importlib.import_module(f"grantlens.plans.{module}")
    from grantlens.plans.registry import JOBS

    return JOBS
