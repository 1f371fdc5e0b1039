"""Typed errors of the table engine."""


class TableError(Exception):
    """Base of all."""


class ActionUnknown(TableError): ...
class ActionJSONFormat(TableError): ...
class CDCNotSupported(TableError): ...
class ParseSchema(TableError): ...
class ConfigValidation(TableError): ...
class InvalidVersion(TableError): ...
class NotATable(TableError): ...
class UnableToLoadVersion(TableError): ...
class MissingMetadata(TableError): ...
class AddZeroSize(TableError): ...
class AddGenerateStats(TableError): ...
class ObjectAlreadyExists(TableError): ...
class ObjectDoesNotExist(TableError): ...
class ObjectIsDir(TableError): ...
class CopyObject(TableError): ...
class DeleteObject(TableError): ...
class LockNotObtained(TableError): ...
class UnableToUnlock(TableError): ...
class StateUnreadable(TableError): ...
class StateEmpty(TableError): ...
class ExceededRetries(TableError): ...
class CheckpointAlreadyExists(TableError): ...
class CheckpointIncomplete(TableError): ...
class CheckpointInvalidName(TableError): ...
class CheckpointEntryMultipleActions(TableError): ...
class CheckpointRowCountMismatch(TableError): ...
class ConcurrentModification(TableError): ...
class AlreadyCommitted(TableError): ...
class AmbiguousMerge(TableError): ...
class AppendOnly(TableError): ...


class ProtocolTooHigh(TableError):
    """The table needs a later reader or writer; `table` is usable at the caller's risk."""

    def __init__(self, message: str, table=None):
        super().__init__(message)
        self.table = table
