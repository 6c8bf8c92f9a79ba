"""Errors of the mapping API: one base with what the service said, and a kind for each way to fail."""

from __future__ import annotations


class MappingError(Exception):
    """Base of all. ``status_code``: of the response, if there was one; ``retry_after``: seconds the service asks to wait, if it said."""

    def __init__(self, message: str = "", *, status_code: int | None = None, retry_after: float | None = None):
        super().__init__(message)
        self.status_code, self.retry_after = status_code, retry_after


def _kind(name: str, about: str) -> type[MappingError]:
    return type(name, (MappingError,), {"__doc__": about, "__module__": __name__})


ConfigError = _kind("ConfigError", "The client can't be set up as asked.")
RequestTimeout = _kind("RequestTimeout", "No answer in time.")
AuthError = _kind("AuthError", "The service knows no such key.")
RateLimitError = _kind("RateLimitError", "The service wants fewer requests.")
ServerError = _kind("ServerError", "The service failed.")
HttpStatusError = _kind("HttpStatusError", "The service refused for another reason.")

#: First and last status of each kind, the special ones first, and whether its text quotes the response.
BY_STATUS = (
    (401, 401, AuthError, False),
    (403, 403, AuthError, False),
    (429, 429, RateLimitError, False),
    (400, 499, HttpStatusError, False),
    (500, 999, ServerError, True),
)
