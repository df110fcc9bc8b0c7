"""What operators raise."""


class VantorError(Exception):
    """Any failure of this library."""


class DimensionMismatch(VantorError):
    def __init__(self, expected: int, actual: int) -> None:
        super().__init__(f"dimension mismatch: expected {expected}, actual {actual}")
        self.expected, self.actual = expected, actual


class NotFound(VantorError):
    """No live row has the id."""


class InvalidSchema(VantorError, ValueError):
    """A collection's declaration breaks a rule."""


class CollectionNotFound(VantorError, KeyError):
    """No collection or alias has the name."""


class CollectionExists(VantorError):
    """The name is taken."""


class InvalidInput(VantorError, ValueError):
    """A value that can't mean anything here."""


class InvalidDimension(InvalidInput):
    """A dimension below 1."""


class InvalidMetric(InvalidInput):
    """No metric has the name."""


class InvalidIndexKind(InvalidInput):
    """No kind of index has the name."""


class InvalidQuantization(InvalidInput):
    """No quantization has the name."""


class InvalidName(InvalidInput):
    """No kind of field or index has the name."""


class Corruption(VantorError):
    """Stored bytes that aren't what their checksum or format says."""


class EncodingError(VantorError):
    """A value that can't be written in a format."""


class DecodingError(VantorError):
    """Bytes or text that can't be read in a format."""


class StorageError(VantorError, OSError):
    """Files or tables that can't be read or written."""
