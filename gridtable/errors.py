"""What can go wrong, by kind."""


class EngineError(Exception):
    """Any error of the engine."""


class ConfigError(EngineError):
    """A table, its specification or a request for one is wrong."""


class InvalidQueryError(EngineError):
    """A query that has no meaning or is not supported."""


class CatalogError(EngineError):
    """The metadata cannot be read or is inconsistent."""


class ConflictError(CatalogError):
    """Another writer committed first."""


class SchemaError(ConfigError):
    """Rows do not fit their table."""


class InvalidChunkNameError(EngineError):
    """A chunk's file name cannot be read."""
