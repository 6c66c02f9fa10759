"""Transcript, tool-call and text-corpus analytics as Spark jobs."""

from talloom.session import build_session, configure

__all__ = ["build_session", "configure"]
