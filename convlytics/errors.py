"""Exception types raised by operators that validate their input."""


class DataValidationError(Exception):
    """Input data is missing columns, is empty, or has clashing names."""


class EmbeddingError(Exception):
    """Nothing to embed, or the embedding function failed."""


class ModelTrainingError(Exception):
    """Training data cannot produce a model (for example a single class)."""
