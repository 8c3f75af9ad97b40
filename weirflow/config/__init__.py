"""Blueprints: loading, interpolation and their format."""

from .loader import PipelineConfig, load_config

__all__ = ["PipelineConfig", "load_config"]
