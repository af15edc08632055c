"""Catalogue of runnable queries, each with the SQL that must give the same rows."""

from verdigraph.plans import answering, budgets, controlling, measuring, prompting, scoring, storing, structure
from verdigraph.plans.registry import REGISTRY

__all__ = [
    "REGISTRY", "answering", "budgets", "controlling", "measuring", "prompting", "scoring", "storing", "structure",
]
