"""Errors of the public surface."""


class WatermarkError(Exception):
    pass


class WatermarkConcurrencyError(WatermarkError):
    pass


class WatermarkExtractionError(WatermarkError):
    pass


class WatermarkCommitError(WatermarkError):
    pass


class MergeError(Exception):
    pass


class PendingRecoveryError(MergeError):
    pass


class AppliedEventConflictError(MergeError):
    pass


class AppliedSequenceConflictError(MergeError):
    pass


class MergeAmbiguityError(MergeError):
    pass


class TargetAlreadyInitializedError(MergeError):
    pass


class CommitConflictError(Exception):
    pass


class CDFError(Exception):
    pass


class CDFSourceNotFoundError(CDFError):
    pass


class CDFSourceAlreadyRegisteredError(CDFError):
    pass


class CDFNotEnabledError(CDFError):
    pass


class CDFInvalidRangeError(CDFError):
    pass
