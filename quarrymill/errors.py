"""What can go wrong, by part of the system."""


class QuarrymillError(Exception):
    """The base of all."""


class ConfigError(QuarrymillError):
    pass


class IngestionError(QuarrymillError):
    pass


class EmbeddingError(QuarrymillError):
    pass


class IndexStoreError(QuarrymillError):
    pass


class RetrievalError(QuarrymillError):
    pass


class GenerationError(QuarrymillError):
    pass
