"""Errors by category; a failed page is a row with an error, a bad config is an exception."""


class PageQueryError(Exception):
    category = "UNKNOWN"

    def __init__(self, message: str, url: str = "", status: int = 0):
        super().__init__(message)
        self.message, self.url, self.status = message, url, status

    def __str__(self) -> str:
        parts = [f"[{self.category}]"]
        if self.url:
            parts.append(f"url={self.url}")
        if self.status:
            parts.append(f"status={self.status}")
        return " ".join([*parts, self.message])


class ConfigError(PageQueryError):
    category = "CONFIG"


class HttpError(PageQueryError):
    category = "HTTP"


class ParseError(PageQueryError):
    category = "PARSE"


class ExtractError(PageQueryError):
    category = "EXTRACT"


class OutputError(PageQueryError):
    category = "IO"


class TimeoutExceeded(PageQueryError):
    category = "TIMEOUT"


class Cancelled(PageQueryError):
    category = "CANCEL"
