"""Errors that the library raises itself."""


class EngineError(Exception):
    """Base of the errors below."""


class SourceError(EngineError):
    """A source is missing or cannot be read."""


class StoreError(EngineError):
    """Vectors and chunks do not fit, or the table is not there."""


class ProviderError(EngineError):
    """A model provider is unknown or not installed."""


class Refused(ProviderError):
    """A service will not do this, however often it is asked."""


class ConfigError(EngineError):
    """A setting is not allowed."""


class IngestError(EngineError):
    """Documents cannot be cleaned, chunked or embedded."""


class RetrievalError(EngineError):
    """A question is blank, or there is nothing to search."""


class AnswerError(EngineError):
    """An answer provider failed for good."""
