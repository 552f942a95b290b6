from __future__ import annotations

import re

import pytest
import regex

from quillspan.functions import checks_py, patterns
from quillspan.functions.checksums import CHECKSUMS
from quillspan.model import SpanError
from quillspan.operators.detect import detect
from quillspan.sources.rules import RuleSet, check_patterns, load_for_corpus, load_rules, parse_rules

TEXTS = ["ñaa aa aaa", "Paciente: Don José Íñigo\u0085x aa.\r\naa", "𝔘 aa 😀 aa", "", None, "DNI 12345678Z, 12345678A; tarjeta 4539578763621486", "xaax aa_ _aa"]


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def rules(*specs):
    return parse_rules({"version": 1, "lang": "es", "rules": list(specs)}, "es").rules


def spec(name="x", layer="regex_checksum", phi_type="ID", **more):
    return {"rule_id": name, "layer": layer, "phi_type": phi_type, **more}


GIVEN = (
    spec("term", "gazetteer", "NAME", terms=["aa", "aaa"]),
    spec("cue", "context_cue", "NAME", cue=["Paciente"], then="capitalised_words", gap=2),
    spec("dni", pattern=r"\b\d{8}[A-Z]\b", checksum="dni_mod23"),
    spec("card", pattern=r"\d{16}", checksum="luhn"),
    spec("line", "regex_checksum", "ORGANISATION", pattern=r"aa."),
)


def test_both_backends_agree_and_offsets_are_code_points(spark):
    given = rules(*GIVEN)
    fields = ("doc_id", "start", "end", "rule_id")
    native, other = ({tuple(r[f] for f in fields) for r in detect(docs(spark), given, backend=b).collect()} for b in ("native", "fallback"))
    assert native == other
    assert (2, 2, 4, "es:term") in native and (2, 7, 9, "es:term") in native
    assert (0, 1, 3, "es:term") not in native  # aa inside ñaa has no edge
    assert {x for x in native if x[3] == "es:dni"} == {(5, 4, 13, "es:dni")}
    assert (1, 10, 24, "es:cue") in native
    for d, s, e, _ in native:
        assert 0 <= s < e <= len(TEXTS[d])


def test_longest_term_wins():
    assert regex.findall(patterns.gazetteer(["New", "New York"]), "New York") == ["New York"]


def test_zero_width_patterns_go_to_the_fallback(spark):
    given = rules(spec("zero", pattern="a*"), spec("some", pattern="a+"), spec("java", pattern=r"(?r)a+"))
    assert check_patterns(spark, given) == {"es:zero": "fallback", "es:some": "native", "es:java": "fallback"}
    got = {(r["doc_id"], r["start"], r["end"]) for r in detect(docs(spark), given[:1]).collect()}
    assert got == {(i, *m.span()) for i, t in enumerate(TEXTS) for m in re.finditer("a+", t or "")}


@pytest.mark.parametrize("name", sorted(CHECKSUMS))
def test_check_digits(spark, name):
    values = ["12345678Z", "12345678A", "12-345.678 z", "X1234567L", "X1234567A", "Y1234567X", "4539578763621486", "4539578763621487", "0", "19", "", "ab", "123"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(CHECKSUMS[name](df.v)).collect()]
    assert got == [getattr(checks_py, name)(v) for v in values]


@pytest.mark.parametrize(
    "bad",
    [
        "no mapping",
        spec("a:b", pattern="x"),
        spec("", pattern="x"),
        spec(layer="tagger", pattern="x"),
        spec(phi_type="OTHER", pattern="x"),
        spec(),
        spec(pattern="x", terms=["y"]),
        spec(terms=[]),
        spec(terms=[" "]),
        spec(cue="x"),
        spec(cue="x", then="word", gap=41),
        spec(cue="x", then="word", gap=True),
        spec(pattern="x", gap=1),
        spec("g", "gazetteer", terms=["x"], checksum="luhn"),
        spec(pattern="x", checksum="none"),
        spec(pattern="x", score=1.5),
        spec(pattern="x", score=True),
        spec(pattern="x", flags=["dotall"]),
        spec(pattern="x", other=1),
    ],
)
def test_refusals(bad):
    with pytest.raises(SpanError):
        rules(bad)


def test_files(tmp_path):
    (tmp_path / "es.yaml").write_text("version: 2\nlang: es\nrules:\n  - {rule_id: a, layer: gazetteer, phi_type: NAME, lexicon: es/names}\n")
    (tmp_path / "lex/es").mkdir(parents=True)
    (tmp_path / "lex/es/names.txt").write_text("# names\nAna\nJosé # two\n\n")
    got = load_rules(tmp_path / "es.yaml", "es", tmp_path / "lex")
    assert got.versions == (("es", 2),) and "José" in got.rules[0].pattern
    assert load_rules(tmp_path / "cat.yaml", "cat") == RuleSet()
    assert [r.rule_id for r in load_for_corpus("es-carmen", tmp_path, tmp_path / "lex").rules] == ["es:a"]
    with pytest.raises(SpanError):
        got + got
    with pytest.raises(SpanError):
        load_rules(tmp_path / "es.yaml", "de")
