"""Names under which call sites elsewhere know these classes and errors."""

from .errors import (
    BackendCompatibilityError,
    BackendError,
    BackendNotAvailableError,
    BackendSelectionError,
    ColumnError,
    ConfigError,
    ConstraintError,
    ConvergenceError,
    DataShapeError,
    DataValidationError,
    EmptyDataError,
    LagConfigurationError,
    LagPreparationError,
    LagPreprocessingError,
    LagSelectionError,
    ModelNotFittedError,
    NotFittedError,
    RankError,
    RegularizerConfigurationError,
    ScalerNotFittedError,
    SchemaMismatchError,
    StationarityNotFittedError,
    TrainingConfigurationError,
    TrainingError,
    ValidationError,
)
from .plans.builder import AnalysisBuilder
from .plans.engine import MultiTaskCausality, PairwiseCausality
from .plans.layout import LagConfiguration
from .plans.selectors import CVLagSelector, ICLagSelector, VARLagSelector
from .plans.solvers import LinearModel, available_solvers, register_solver

MultiTaskGrangerAPI = MultiTaskCausality
SimpleGrangerAPI = PairwiseCausality
MultiTaskGrangerBuilder = MultitaskGrangerBuilder = AnalysisBuilder

# other names of the same errors
ConfigurationError, ConstraintConfigurationError = ConfigError, ConstraintError
MissingColumnsError, ColumnMismatchError = ColumnError, SchemaMismatchError
BackendExecutionError, NumericalStabilityError = TrainingError, RankError

__all__ = [
    "AnalysisBuilder", "BackendCompatibilityError", "BackendError", "BackendNotAvailableError", "BackendSelectionError", "CVLagSelector", "ConvergenceError", "DataShapeError", "DataValidationError", "EmptyDataError", "ICLagSelector",
    "LagConfiguration", "LagConfigurationError", "LagPreparationError", "LagPreprocessingError", "LagSelectionError", "LinearModel", "ModelNotFittedError", "MultiTaskCausality", "MultiTaskGrangerAPI", "MultiTaskGrangerBuilder",
    "MultitaskGrangerBuilder", "NotFittedError", "PairwiseCausality", "RegularizerConfigurationError", "ScalerNotFittedError", "SimpleGrangerAPI", "StationarityNotFittedError", "TrainingConfigurationError", "TrainingError", "VARLagSelector",
    "ValidationError", "available_solvers", "register_solver",
]
