"""Contracts and expectations: each frame is checked by one aggregate job at most."""

from .contracts import DataframeContract, Expectation, check_contract, check_expectations

__all__ = ["DataframeContract", "Expectation", "check_contract", "check_expectations"]
