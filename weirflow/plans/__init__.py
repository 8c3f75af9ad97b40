"""From a blueprint to Spark plans and their execution."""

from .context import ExecutionContext, Frames
from .orchestrator import Orchestrator, run_pipeline

__all__ = ["ExecutionContext", "Frames", "Orchestrator", "run_pipeline"]
