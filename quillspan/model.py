"""Vocabularies and schemas of the span engine."""

from __future__ import annotations

from collections.abc import Iterable

# The closed vocabularies.
CORPORA = ("ko-surro", "es-meddocan", "de-grascco", "es-carmen", "en-n2c2")
DETECTORS = ("R", "T", "RT", "RT-Arb", "RT-Aud", "RT-Arb-Aud")
LAYERS = ("regex_checksum", "context_cue", "gazetteer", "tagger")
PHI_TYPES = ("NAME", "DATE", "AGE", "LOCATION_AREA", "LOCATION_STREET", "ORGANISATION", "CONTACT", "ID", "PROFESSION", "OTHER")
SUPERVISIONS = ("sup-free", "sup-human")
PORTINGS = ("port-oneshot", "port-oneshot-nofence", "port-loop", "port-multi", "port-selfdesign", "port-human")
MODEL_CONSULTED = ("none", "mechanical", "notation", "rule_content")
LANGS = ("es", "cat", "de", "ko", "en")
SPLITS = ("train", "dev", "test")
TERMINATION_REASONS = ("converged", "ceiling", "not_applicable")
REFUSALS = ("out_of_range", "inside_a_mask_tag", "undeclared_phi_type", "crosses_a_line", "malformed")
LAYER_FAMILIES = {"rules": ("regex_checksum", "context_cue", "gazetteer"), "tagger": ("tagger",)}
CORPUS_RULE_LANGS = {"es-meddocan": ("es",), "es-carmen": ("es", "cat"), "de-grascco": ("de",), "ko-surro": ("ko",), "en-n2c2": ("en",)}
EXCLUDED_TYPES = ("SEXO", "FAMILIARES", "NAME_TITLE")
MIXED_TAG = "[PHI]"
NON_TARGET_TYPES = frozenset({"OTHER"})
SEALED_SPLIT = "test"
MODES = ("fully_covered", "relaxed")

AXES = {
    "corpus": CORPORA,
    "detector": DETECTORS,
    "layer": LAYERS,
    "phi_type": PHI_TYPES,
    "supervision": SUPERVISIONS,
    "porting": PORTINGS,
    "model_consulted": MODEL_CONSULTED,
    "lang": LANGS,
    "split": SPLITS,
    "termination_reason": TERMINATION_REASONS,
    "audit_refusal": REFUSALS,
}

FAMILY_OF = {layer: family for family, layers in LAYER_FAMILIES.items() for layer in layers}

DOCS = "corpus string, doc_id string, text string, split string, had_bom boolean, meta map<string,string>"
ACTIONS = "array<struct<agent:string,action:string,call_id:string>>"
GOLD = "corpus string, doc_id string, span_index int, start int, end int, surface string, subtype string, phi_type string, excluded boolean"
PREDICTED = f"doc_id string, start int, end int, phi_type string, layer string, detector string, rule_id string, score double, agent_actions {ACTIONS}"
ERRORS = "doc_id string, span_index int, phi_type string, kind string, start int, end int"
SPAN_FIELDS = tuple(f.split()[0] for f in PREDICTED.split(", "))
ERROR_FIELDS = tuple(f.split()[0] for f in ERRORS.split(", "))


class SpanError(ValueError):
    """Input that the engine refuses.  Messages name ids and counts, never texts."""


def check_value(axis: str, value: str) -> str:
    """The value, or a refusal if its axis doesn't list it."""
    if value not in AXES[axis]:
        raise SpanError(f"{value!r} is not a {axis}")
    return value


def check_partition(families: dict[str, Iterable[str]] | None = None, layers: Iterable[str] = LAYERS) -> None:
    """Refuse families that miss a layer, repeat one or hold an unknown one."""
    given = [x for group in (families or LAYER_FAMILIES).values() for x in group]
    if len(given) != len(set(given)) or set(given) != set(layers):
        raise SpanError("layer families don't partition the layers")
