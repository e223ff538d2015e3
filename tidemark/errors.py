"""What the engine refuses, and why."""


class Refused(ValueError):
    """A request that the engine doesn't take."""


class Conflict(RuntimeError):
    """Somebody else changed the table meanwhile."""


class Missing(KeyError):
    """No such table, column or view."""

    def __str__(self) -> str:
        return str(self.args[0])
