"""What operators raise; matched by class, never by text."""


class EngineError(Exception):
    """Base of all errors raised here."""


class GraphInputError(EngineError):
    """A vertex, edge or option that the graph's capabilities do not allow."""


class NotFoundError(GraphInputError):
    """A vertex, edge, source or target that does not exist."""


class NumericPolicyError(EngineError):
    """A value that the numeric policy rejects (NaN, infinity, negative weight, wrong shape)."""


class ShapeError(NumericPolicyError):
    """Dimensions that do not fit."""


class SingularError(NumericPolicyError):
    """A matrix without the factorisation asked for."""


class UnreachableError(EngineError):
    """No path, or no alignment inside the window."""


class CycleError(EngineError):
    """A cycle where none is allowed."""


class NegativeCycleError(CycleError):
    """A cycle of negative length."""


class DisconnectedError(EngineError):
    """More than one component where one is needed."""


class LimitError(EngineError):
    """A size or round limit was passed."""


class TraversalStopped(EngineError):
    """A hook ended the traversal; ``partial`` holds what was visited."""

    def __init__(self, message: str, partial=None):
        super().__init__(message)
        self.partial = partial
