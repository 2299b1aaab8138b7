"""Errors, with one base; transient ones may be tried again, permanent ones never."""


class TidemarkError(Exception):
    """Base of all errors of this library."""


class ConfigurationError(TidemarkError):
    pass


class IngestionError(TidemarkError):
    pass


class TransientIngestionError(IngestionError):
    """Worth another try."""


class RateLimitError(TransientIngestionError):
    pass


class PermanentIngestionError(IngestionError):
    """Another try would fail alike."""


class SeriesNotFoundError(PermanentIngestionError):
    pass


class AuthenticationError(PermanentIngestionError):
    pass


class ResponseValidationError(PermanentIngestionError):
    pass


class StorageError(TidemarkError):
    pass


class VintageMismatchError(TidemarkError):
    """Values of different snapshots meet."""


class InsufficientDataError(TidemarkError):
    pass


class ExplanationError(TidemarkError):
    pass
