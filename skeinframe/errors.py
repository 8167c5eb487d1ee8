"""Error kinds of the API."""


class SkeinError(Exception):
    """Base of all errors raised by the library."""


class InvalidRequest(SkeinError):
    """Bad options or arguments; raised before anything runs."""


class Unsupported(SkeinError):
    """A type or feature that the engine doesn't have."""


class ComputeError(SkeinError):
    """A failure while a plan runs."""


class IoError(SkeinError):
    """A failure of a reader or writer."""


class Cancelled(SkeinError):
    """A job or stream was cancelled."""


def require(ok: bool, message: str) -> None:
    if not ok:
        raise InvalidRequest(message)
