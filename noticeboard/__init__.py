"""Public-notice analytics as Spark DataFrame operators."""

from noticeboard.session import build_session

__all__ = ["build_session"]
