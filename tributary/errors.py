"""Typed errors; value-like and runtime-like ones can be caught by the built-in classes too."""


class TributaryError(Exception):
    """Base of all errors raised here."""


class ConfigError(TributaryError, ValueError):
    """A configuration that can't be understood."""


class LagConfigurationError(ConfigError):
    """Lags that are negative or crossed, or lag settings that can't be met."""


class TrainingConfigurationError(ConfigError):
    """Settings of a fit that can't be met."""


class RegularizerConfigurationError(ConfigError):
    """A penalty that can't be understood."""


class ConstraintError(ConfigError):
    """Relation rules or constraints that contradict one another or the mask."""


class HyperoptError(ConfigError):
    """A search that can't run."""


class ValidationError(TributaryError, ValueError):
    """Input that doesn't fit the request."""


class DataValidationError(ValidationError):
    """Data that don't fit the request."""


class EmptyDataError(DataValidationError):
    """No rows or no segments."""


class DataShapeError(DataValidationError):
    """Rows or columns of the wrong number."""


class ColumnError(DataValidationError):
    """Missing or unknown columns."""


class SchemaMismatchError(DataValidationError):
    """Segments with different columns."""


class NotFittedError(TributaryError, RuntimeError):
    """Used before it was fitted."""


class ModelNotFittedError(NotFittedError):
    """Predictions or weights of a fit that wasn't made."""


class ScalerNotFittedError(NotFittedError):
    """A scaler without its constants."""


class StationarityNotFittedError(NotFittedError):
    """Orders of differencing that weren't looked for."""


class LagPreprocessingError(TributaryError, RuntimeError):
    """Lags that can't be taken of these data."""


class LagSelectionError(LagPreprocessingError):
    """A search for lags that can't run."""


class LagPreparationError(LagPreprocessingError):
    """Features that can't be made: no rows are left."""


class BackendError(TributaryError, RuntimeError):
    """A solver that can't be used."""


class BackendSelectionError(BackendError, ValueError):
    """A solver that nobody knows."""


class BackendNotAvailableError(BackendError):
    """A known solver that can't run here."""


class BackendCompatibilityError(BackendError):
    """Something that isn't a solver, or settings that it doesn't take."""


class TrainingError(TributaryError, RuntimeError):
    """A fit that went wrong."""


class ConvergenceError(TrainingError):
    """Weights that are no numbers."""


class RankError(TrainingError):
    """A design without full rank, or without active coefficients."""
