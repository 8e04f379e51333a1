"""What can go wrong, as exceptions."""


class StoreError(Exception):
    """Base of all errors of this package."""


class NotInitialized(StoreError):
    """The store has no catalog (yet)."""


class CatalogError(StoreError):
    """A catalog cannot be read, does not parse, or does not belong to the store."""


class AmbiguousStore(StoreError):
    """A folder holds several stores and none was named."""


class UnknownKey(StoreError):
    """A key or kind is not known, or is of another kind."""


class InvalidArtifact(StoreError):
    """The data does not have the form that its kind needs."""


class SchemaMismatch(StoreError):
    """Columns, types or dimensions are not those expected."""


class OutOfBounds(StoreError):
    """A coordinate or id lies outside its range."""


class TooLarge(StoreError):
    """A matrix is too large for one process."""


class AlreadyExists(StoreError):
    """The artifact is there already."""


class NotFound(StoreError):
    """There is no such file."""


class UnsupportedFormat(StoreError):
    """The file's extension is not one that can be read or written."""
