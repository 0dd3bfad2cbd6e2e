"""Named queries over the test tables, each with the SQL it must agree with where SQL can say it."""

# The quick checks come first: those of whole jobs take most of the time
from storystream.plans.catalog import text  # isort: skip
from storystream.plans.catalog import tables  # isort: skip
from storystream.plans.catalog import jobs  # isort: skip
from storystream.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "jobs", "tables", "text"]
