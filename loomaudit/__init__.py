"""Audits prediction datasets for leakage; names are loaded when they are first used."""

from importlib import import_module

__version__ = "0.1.0"

#: Public names and where they live.
_PUBLIC = {
    "audit": (
        "AuditReport run_audit", ),
    "errors": ("AuditError CheckError InputError RegistryError ReportError SchemaError SplitsError TaskSpecError", ),
    "functions.normalize": ("coerce_events events_hash", ),
    "operators.registry": ("Check all_checks check_ids get_check register register_check resolve_checks", ),
    "plans.context": ("AuditContext", ),
    "plans.evidence": ("Finding Severity Skipped make_finding", ),
    "plans.task": ("CodeSet Duration FollowUp IndexDef OutcomeDef SplitRules TaskSpec", ),
    "sources.features": ("FeatureMatrix build_feature_matrix build_labels read_feature_matrix read_labels", ),
    "sources.meds": ("read_meds_events write_meds_dataset", ),
    "sources.omop": ("read_omop_events", ),
    "sources.splits": ("read_splits splits_from_mapping", ),
    "report.render": ("render_html render_markdown write_report", ),
    "synth.generate": ("Cohort generate", ),
    "synth.inject": ("INJECTORS Injection inject_many injector_ids", ),
}
_WHERE = {name: module for module, (names,) in _PUBLIC.items() for name in names.split()}
#: Names under which users of audits may know things.
_ALSO = {"BaseCheck": ("operators.registry", "Check"), "SkippedCheck": ("plans.evidence", "Skipped"), "SplitsSpec": ("plans.task", "SplitRules"), "checks": ("operators.checks", None), "context": ("plans.context", None), "exceptions": ("errors", None), "inject": ("synth.inject", "inject"), "io": ("sources", None), "report": ("report", None), "schemas": ("plans", None), "synth": ("synth", None), "splits": ("sources.splits", None)}

__all__ = sorted([*_WHERE, *_ALSO, "__version__"])


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
    if name in _ALSO:
        module, attribute = _ALSO[name]
        found = import_module(f"{__name__}.{module}")
        return getattr(found, attribute) if attribute else found
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")


def __dir__():
    return __all__
