"""Typed errors and warnings."""


class SchemaloomError(Exception):
    """Base of all errors raised here."""


class ConfigError(SchemaloomError):
    """A caller passed something that cannot work: an unknown label, property, column or option."""


class StateError(SchemaloomError):
    """A step was called before the step it needs."""


class ExtractionError(SchemaloomError):
    """A source could not be read in the expected shape."""


class LoadError(SchemaloomError):
    """The graph would break one of its constraints."""


class SchemaloomWarning(UserWarning):
    """Base of all warnings issued here."""
