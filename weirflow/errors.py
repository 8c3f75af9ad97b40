"""Exceptions. All derive from ``WeirflowError``; bad blueprints raise before data is read."""


class WeirflowError(Exception):
    """Root of the package's errors."""


class ConfigError(WeirflowError):
    """A blueprint that can't be used."""


class DependencyError(ConfigError):
    """Tasks that wait for each other."""


class InterpolationError(ConfigError):
    """A ``${...}`` token that has no value."""


class SecretError(ConfigError):
    """A secret that no provider has."""


class StateError(WeirflowError):
    """A frame that doesn't exist."""


class RegistryError(WeirflowError):
    """An unknown or a repeated name."""


class AdapterError(WeirflowError):
    """A source or sink that can't do what is asked."""


class PermissionDeniedError(AdapterError):
    """A resource that doesn't allow the operation."""


class TransformError(WeirflowError):
    """A step that can't be applied."""


class ExpressionError(TransformError):
    """A predicate or expression that can't be compiled."""


class ContractError(WeirflowError):
    """A frame that breaks its contract."""


class ExpectationError(WeirflowError):
    """A failed expectation."""
