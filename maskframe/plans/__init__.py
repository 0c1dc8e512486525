"""Named queries."""

from . import learned, more, registry, shapes  # noqa: E402, F401
