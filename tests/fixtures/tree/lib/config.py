"""Configuration."""

import os
from .other import load as read, save

LIMIT = 10


class Config(Base):
    """Holds settings."""

    kind = "plain"

    def __init__(self, path):
        self.data = read(path)

    @property
    async def size(self) -> int:
        """How many."""

        def inner():
            return len(self.data)

        return inner()


# Makes one.
def make(path: str, *args, **more) -> Config:
    """Make a config.

    Long text.
    """
    return Config(os.path.join(path, helper(args)))
