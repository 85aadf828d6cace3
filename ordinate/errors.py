"""Errors that the driver raises before any job is submitted."""


class OrdinateError(Exception):
    """Base of the errors below."""


class ConfigError(OrdinateError):
    """A setting is out of its range."""


class ShapeError(OrdinateError):
    """Shapes do not fit the operation."""


class RankError(ShapeError):
    """A tensor has the wrong number of axes."""


class AutodiffError(OrdinateError):
    """A gradient was asked for that does not exist."""


class StateDictError(OrdinateError):
    """Names or shapes of a state dict do not fit."""
