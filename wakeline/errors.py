"""Errors of the query language, with the place in the text that they point to."""

from __future__ import annotations


class QueryError(Exception):
    """Any fault in a query."""


class CompileError(QueryError):
    """A valid query that cannot be turned into a plan."""


class ParseError(QueryError):
    """A fault at a place in the text; line and column count from 0."""

    def __init__(self, message: str, text: str = "", position: int = -1, width: int = 1) -> None:
        self.message, self.position = message, max(0, position)
        head = text[: self.position]
        self.line = head.count("\n")
        self.column = len(head) - (head.rfind("\n") + 1)
        source = text.split("\n")[self.line] if text else ""
        where = f"Error at line:{self.line + 1},column:{self.column + 1}\n" if text else ""
        mark = f"\n{source}\n{' ' * self.column}{'^' * max(1, min(width, len(source) - self.column))}" if text else ""
        super().__init__(f"{where}{message}{mark}")


class SyntaxFault(ParseError):
    """Text that is no query."""


class SemanticFault(ParseError):
    """A query that means nothing: unknown functions, wrong counts and places."""


class SchemaFault(SemanticFault):
    """A field or event type that the schema does not have."""


class TypeFault(SemanticFault):
    """Values of types that do not go together."""
