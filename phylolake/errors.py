"""Error taxonomy of the public API (raised on the driver, never inside a plan)."""


class PhylolakeError(Exception):
    """Base class of every error raised by this package."""


class SchemaVersionError(PhylolakeError):
    """The release was written with an incompatible schema version."""


class InvalidId(PhylolakeError):
    """An identifier cannot be resolved."""


class AmbiguousId(InvalidId):
    """An identifier resolves to more than one gene."""

    def __init__(self, message, candidates=()):
        super().__init__(message)
        self.candidates = list(candidates)


class UnknownSpecies(InvalidId):
    """No genome matches the given code, name or taxon id."""


class UnknownLevel(InvalidId):
    """A taxonomic level is not defined for the requested group."""


class OutdatedGroupId(InvalidId):
    """The group id carries the letters of another release."""


class Singleton(InvalidId):
    """The entry belongs to no hierarchical group."""


class NoRepresentative(InvalidId):
    """The family has no representative entry."""


class InvalidTaxonomy(PhylolakeError):
    """The parent table holds a cycle or an unknown parent."""


class TooUnspecificQuery(PhylolakeError):
    """A text query matches more rows than the caller allows."""

    def __init__(self, message, hits):
        super().__init__(message)
        self.hits = hits


class BoundExceeded(PhylolakeError):
    """A side that has to be small for the chosen plan is larger than its stated bound."""


class NoSharedFolder(PhylolakeError):
    """A cluster without a folder that all executors share."""
