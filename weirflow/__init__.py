"""Weirflow: declarative batch pipelines compiled into lazy Spark plans."""

from . import operators, sources
from .config import PipelineConfig, load_config
from .operators import build_transform
from .plans import ExecutionContext, Frames, Orchestrator, run_pipeline
from .registry import register_adapter, register_expression, register_load_strategy, register_notifier, register_secret_provider, register_transform

__version__ = "0.1.0"
__all__ = [
    "ExecutionContext",
    "Frames",
    "Orchestrator",
    "PipelineConfig",
    "build_transform",
    "load_config",
    "operators",
    "register_adapter",
    "register_expression",
    "register_load_strategy",
    "register_notifier",
    "register_secret_provider",
    "register_transform",
    "run_pipeline",
    "sources",
]
