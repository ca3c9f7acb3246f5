"""Python code as data: what this Python takes, without a row that ends a job."""

from __future__ import annotations

import ast

#: What reading code can raise; deeply nested code exhausts the parser's memory or stack.
UNREADABLE = (SyntaxError, ValueError, MemoryError, RecursionError)


def parsed(code: str) -> ast.Module | None:
    """The syntax tree, or None if this Python does not take the code."""
    try:
        return ast.parse(code)
    except UNREADABLE:
        return None


def compiles(code: str) -> bool:
    """Whether this Python takes the code."""
    try:
        compile(code, "<code>", "exec")
    except UNREADABLE:
        return False
    return True
