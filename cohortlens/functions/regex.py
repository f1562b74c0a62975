"""Regex dialect helpers.

The reference matches with Python ``re`` on text: ``.`` stops only at ``\\n`` (Java's UNIX_LINES, ``(?d)``); ``\\s``,
``\\d`` and ``\\w`` cover Unicode (``(?U)``); and ``re.IGNORECASE`` folds case beyond ASCII (``(?iU)``).
"""

from __future__ import annotations


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    return ("(?idU)" if ignore_case else "(?dU)") + pattern
