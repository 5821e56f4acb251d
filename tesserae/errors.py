"""Errors. All that can be decided on the driver is raised there, before a plan runs."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors; keyword arguments become attributes."""

    def __init__(self, message: str = "", **details):
        super().__init__(message or type(self).__name__)
        self.__dict__.update(details)


def _kind(name: str, doc: str) -> type[EngineError]:
    return type(name, (EngineError,), {"__doc__": doc, "__module__": __name__})


InvalidCombinatorialLimitError = _kind("InvalidCombinatorialLimitError", "The limit isn't a positive whole number below 2**53.")
InvalidAttributionRootError = _kind("InvalidAttributionRootError", "The root of attribution isn't an absolute path.")
DetachedSelfError = _kind("DetachedSelfError", "A self reference outside of its recursion.")
UnterminableRecursiveError = _kind("UnterminableRecursiveError", "No terminal form can be derived from the body.")
UnknownKindError = _kind("UnknownKindError", "A schema of a kind that isn't known.")
EmptyItemsError = _kind("EmptyItemsError", "An enum or choice without items.")
PrototypePollutionError = _kind("PrototypePollutionError", "A reserved field name.")
DetachedComputeError = _kind("DetachedComputeError", "A computed field without an object around it.")
ComputeResultMismatchError = _kind("ComputeResultMismatchError", "A resolver's column has another type than its source.")
UnknownOverrideFieldError = _kind("UnknownOverrideFieldError", "An override of a field that isn't there.")
InvalidOverrideValueError = _kind("InvalidOverrideValueError", "An override whose value has the wrong shape.")
IllegalOmittedOverrideError = _kind("IllegalOmittedOverrideError", "Omitted for a field that can't be omitted.")
EnumerationIndexError = _kind("EnumerationIndexError", "An index beyond an axis.")
UnpinnableKindError = _kind("UnpinnableKindError", "A pin on a drawn kind.")
CombinatorialLimitExceededError = _kind("CombinatorialLimitExceededError", "More combinations than the limit.")
UnrepresentableRecordKeyError = _kind("UnrepresentableRecordKeyError", "A record keyed by symbols has no such schema.")
EmptyRangeError = _kind("EmptyRangeError", "No value lies in the range.")
InvalidDistributionBoundError = _kind("InvalidDistributionBoundError", "A bound that the distribution can't have.")
InvalidWeightError = _kind("InvalidWeightError", "A weight that is negative or not finite.")
NoDrawableOutcomesError = _kind("NoDrawableOutcomesError", "All weights are zero.")
TraceKindMismatchError = _kind("TraceKindMismatchError", "A replayed trace belongs to another kind.")
NoActiveScopeError = _kind("NoActiveScopeError", "A vocabulary builder called for a value outside of a generation.")
InvalidClockError = _kind("InvalidClockError", "A clock beyond the range of dates.")
PlanTooLargeError = _kind("PlanTooLargeError", "A schema that unrolls to more nodes than a plan may have.")
MissingOrdinalError = _kind("MissingOrdinalError", "A sequence where no dense ordinal is known.")
ClashingNameError = _kind("ClashingNameError", "Two columns of one name.")
