"""Threadloom: Spark jobs over linked notes, parsed documents and interaction logs."""

from threadloom.session import get_session

__all__ = ["get_session"]
