"""Errors of the engine, by kind."""

from __future__ import annotations


class EngineError(Exception):
    """Any error that the engine reports to a caller."""


class ParseError(EngineError):
    """A document or mapping is not what was declared."""


class ValidationError(EngineError):
    """A mapping or name is not allowed."""


class SearchError(EngineError):
    """An index or field is not there."""


class FileError(EngineError):
    """Stored state is missing or was changed by another run."""
