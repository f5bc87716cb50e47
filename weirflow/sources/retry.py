"""Errors of sources and how they are retried."""

from __future__ import annotations

import time
from collections.abc import Callable

FIRST_WAIT, LONGEST_WAIT = 0.1, 10.0


class TerminalError(Exception):
    """Retrying can't help: the query fails."""


class EndOfInput(Exception):
    """The source is bounded and read to its end."""


def with_retries(read: Callable, attempts: int = 10, sleep: Callable[[float], None] = time.sleep):
    """read(), again after 0.1 s, 0.2 s, 0.4 s, ... (10 s at most) if it fails. What isn't known to be terminal may be retried."""
    for k in range(attempts):
        try:
            return read()
        except (TerminalError, EndOfInput):
            raise
        except Exception:
            if k == attempts - 1:
                raise
            sleep(min(LONGEST_WAIT, FIRST_WAIT * 2**k))
