"""Errors that callers may handle; the command line turns them into messages."""


class RiverGraphError(Exception):
    pass


class MissingColumnsError(RiverGraphError):
    pass


class InvalidInputSchemaError(RiverGraphError):
    pass


class MissingCrsError(RiverGraphError):
    pass


class DuplicateSegmentIdError(RiverGraphError):
    pass


class OutletNotFoundError(RiverGraphError):
    pass


class TopologyCycleError(RiverGraphError):
    pass


class UnsupportedOutputFormatError(RiverGraphError):
    pass


class TerrainProductsError(RiverGraphError):
    pass
