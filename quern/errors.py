"""Errors a caller may want to tell apart."""


class QuernError(Exception):
    """Base of all."""


class ConfigError(QuernError):
    """A setting that can't be used."""


class EmbeddingError(QuernError):
    """Vectors that couldn't be made."""


class IndexingError(QuernError):
    """An index that can't be written or read."""


class TooLargeError(RuntimeError):
    """What a provider raises when a batch or text exceeds its memory or context."""
