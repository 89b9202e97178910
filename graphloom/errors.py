"""Typed errors; callers test classes, not messages."""


class GraphError(Exception):
    """Any error of this engine."""


class NotExistsError(GraphError):
    """A vertex, edge, job or task that is asked for is not there."""


class AlreadyExistsError(GraphError):
    """A key that is added is there already."""


class CycleError(GraphError):
    """An acyclic graph is asked for."""


class NegativeCycleError(GraphError):
    """Shortest paths do not exist."""


class DisconnectedError(GraphError):
    """A connected graph is asked for."""


class NoSolutionError(GraphError):
    """No matching, colouring ... of the kind that is asked for exists."""


class ComponentTooLargeError(GraphError):
    """An exact sequential kernel would have to hold more edges than its documented limit."""


def is_not_exists(error: BaseException) -> bool:
    return isinstance(error, NotExistsError)


def is_already_exists(error: BaseException) -> bool:
    return isinstance(error, AlreadyExistsError)
