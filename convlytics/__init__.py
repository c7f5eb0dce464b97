"""convlytics: conversation analytics as Spark DataFrame operators.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` and is
lazy unless it has to validate input or fit a model.
"""

from convlytics.errors import DataValidationError, EmbeddingError, ModelTrainingError
from convlytics.session import checkpoint_dir, get_session

__all__ = [
    "DataValidationError",
    "EmbeddingError",
    "ModelTrainingError",
    "checkpoint_dir",
    "get_session",
]
