"""Declarative rule files: reading, validation, compilation to matchers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from quillspan.functions import patterns
from quillspan.functions.checksums import CHECKSUMS
from quillspan.model import CORPUS_RULE_LANGS, LANGS, LAYER_FAMILIES, NON_TARGET_TYPES, PHI_TYPES, SpanError
from quillspan.operators import lexicon

FORMS = ("pattern", "terms", "lexicon", "cue")
KEYS = frozenset({"rule_id", "layer", "phi_type", *FORMS, "then", "gap", "checksum", "flags", "case_sensitive", "score", "comment"})


@dataclass(frozen=True)
class Rule:
    rule_id: str
    layer: str
    phi_type: str
    pattern: str  #: in Java's dialect; empty for a rule that is a join
    group: int = 0
    checksum: str | None = None
    score: float | None = None
    source: str = ""
    terms: tuple[str, ...] = ()  #: of a lexicon too large for a pattern
    fold: bool = False  #: whether these match regardless of case


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...] = ()
    versions: tuple[tuple[str, int], ...] = ()

    def __add__(self, other: RuleSet) -> RuleSet:
        ids = [r.rule_id for r in (*self.rules, *other.rules)]
        if len(ids) != len(set(ids)):
            raise SpanError("a rule_id stands twice")
        return RuleSet(self.rules + other.rules, self.versions + other.versions)


def read_lexicon(ref: str, root: str | Path) -> list[str]:
    """Terms of ``lang/name``: a line each, # begins a comment; an empty list is refused."""
    if not re.fullmatch(r"[a-z]+/[A-Za-z0-9_\-]+", ref):
        raise SpanError(f"lexicon reference {ref!r} is not lang/name")
    lines = (x.split("#")[0].strip() for x in (Path(root) / f"{ref}.txt").read_text(encoding="utf-8").splitlines())
    if not (terms := [x for x in lines if x]):
        raise SpanError(f"lexicon {ref} is empty")
    return terms


def _texts(value, what: str, rule: str) -> list[str]:
    value = [value] if isinstance(value, str) else value
    if not isinstance(value, list) or not value or not all(isinstance(x, str) and x.strip() for x in value):
        raise SpanError(f"{rule}: {what} must be one or more non-empty strings")
    return value


def compile_rule(spec: dict, lang: str, lexicons: str | Path = "lexicons", source: str = "") -> Rule:
    """A validated rule with its id prefixed by the language."""
    if not isinstance(spec, dict):
        raise SpanError("a rule must be a mapping")
    name = spec.get("rule_id")
    if not isinstance(name, str) or not name or ":" in name:
        raise SpanError("a rule needs an unprefixed rule_id")
    refuse = lambda why: SpanError(f"{name}: {why}")
    if unknown := set(spec) - KEYS:
        raise refuse(f"unknown keys {sorted(unknown)}")
    layer, phi_type = spec.get("layer"), spec.get("phi_type")
    if layer not in LAYER_FAMILIES["rules"]:
        raise refuse("layer is not one that rules produce")
    if phi_type not in PHI_TYPES or phi_type in NON_TARGET_TYPES:
        raise refuse("phi_type can't be a rule's")
    forms = [f for f in FORMS if f in spec]
    if len(forms) != 1:
        raise refuse(f"needs exactly one of {', '.join(FORMS)}")
    flags = spec.get("flags", [])
    if not isinstance(flags, list) or any(f not in patterns.FLAGS for f in flags):
        raise refuse("flags are not known")
    folded = spec.get("case_sensitive", False)
    if not isinstance(folded, bool):
        raise refuse("case_sensitive must be true or false")
    checksum = spec.get("checksum")
    if checksum is not None and (layer != "regex_checksum" or checksum not in CHECKSUMS):
        raise refuse("checksum is unknown, or the layer takes none")
    score = spec.get("score")
    if score is not None and (isinstance(score, bool) or not isinstance(score, int | float) or not 0 <= score <= 1):
        raise refuse("score must lie in [0, 1]")
    if forms != ["cue"] and {"then", "gap"} & set(spec):
        raise refuse("then and gap belong to cue rules")
    group, fold, large = 0, False, ()
    match forms[0]:
        case "pattern":
            body = _texts(spec["pattern"], "pattern", name)[0]
        case "cue":
            if not isinstance(spec.get("then"), str) or not spec["then"]:
                raise refuse("a cue needs then")
            gap = spec.get("gap", patterns.USUAL_GAP)
            if isinstance(gap, bool) or not isinstance(gap, int) or not 0 <= gap <= patterns.MOST_GAP:
                raise refuse(f"gap must be a whole number up to {patterns.MOST_GAP}")
            body, group = patterns.cue(_texts(spec["cue"], "cue", name), spec["then"], gap), 1
        case form:
            terms = read_lexicon(spec[form], lexicons) if form == "lexicon" else _texts(spec[form], form, name)
            fold = not folded or "ignorecase" in flags
            if len(terms) > lexicon.MOST_ALTERNATION:
                large = tuple(terms)
            else:
                body = patterns.gazetteer(terms)
    pattern = "" if large else patterns.java(body, flags, fold)
    return Rule(f"{lang}:{name}", layer, phi_type, pattern, group, checksum, None if score is None else float(score), source, large, fold)


def parse_rules(data: dict, lang: str, lexicons: str | Path = "lexicons", source: str = "") -> RuleSet:
    if lang not in LANGS:
        raise SpanError(f"{lang!r} is not a language")
    if not isinstance(data, dict) or data.get("lang") != lang:
        raise SpanError(f"rule file is not one of {lang}")
    version = data.get("version")
    if isinstance(version, bool) or not isinstance(version, int) or version < 1:
        raise SpanError("version must be a whole number from 1")
    rules = tuple(compile_rule(x, lang, lexicons, source) for x in data.get("rules") or [])
    return RuleSet() + RuleSet(rules, ((lang, version),))


def load_rules(path: str | Path, lang: str, lexicons: str | Path = "lexicons") -> RuleSet:
    """Rules of a YAML (or JSON) file; a file that isn't there is an empty set."""
    path = Path(path)
    if not path.exists():
        return RuleSet()
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        data = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:  # the reader is optional; JSON rule files always work
            raise SpanError("reading YAML rules needs PyYAML") from e
        try:
            data = yaml.safe_load(text)
        except yaml.YAMLError:
            raise SpanError(f"{path.name} is not YAML") from None
    return parse_rules(data, lang, lexicons, path.name)


def load_for_corpus(corpus: str, root: str | Path, lexicons: str | Path = "lexicons") -> RuleSet:
    """All languages' rules of a corpus."""
    out = RuleSet()
    for lang in CORPUS_RULE_LANGS[corpus]:
        out += load_rules(Path(root) / f"{lang}.yaml", lang, lexicons)
    return out


def check_patterns(spark, rules: Iterable[Rule]) -> dict[str, str]:
    """native, fallback or join for each rule: what the JVM can't compile, or what can match nothing, goes to the fallback."""
    java = spark._jvm.java.util.regex.Pattern
    out = {}
    for r in rules:
        if r.terms:
            out[r.rule_id] = "join"
            continue
        try:
            out[r.rule_id] = "fallback" if java.compile(r.pattern).matcher("").find() else "native"
        except Exception:  # noqa: BLE001 - any refusal of the JVM's compiler
            out[r.rule_id] = "fallback"
    return out
