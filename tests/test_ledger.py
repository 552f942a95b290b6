from __future__ import annotations

import json

import pytest

from quillspan.model import SpanError
from quillspan.plans import ledger, rounds

ARM = {"corpus": "es-meddocan", "detector": "R", "supervision": "sup-free", "porting": "port-loop"}
RUN = ARM | {"split": "dev", "model_id": "none", "generated": "2026-01-02T03:04:05Z", "tree": "clean", "commit": "abc"}
COST = {"llm_calls": 0, "prompt_tokens": 0, "completion_tokens": 0, "wall_seconds": 0.0}


def scored(rate):
    return {"modes": {"fully_covered": {"leak": {"leak_rate": rate}, "layers": {("a|b", True): 1}}}}


def test_paths():
    assert str(ledger.path_of("itermetrics", "/x", iteration=3, **ARM)) == "/x/results/es-meddocan/R/sup-free/port-loop/iter3/metrics.json"
    for bad in ({"iteration": 0}, {"iteration": True}, {}):
        with pytest.raises(SpanError):
            ledger.path_of("itermetrics", **ARM, **bad)
    with pytest.raises(SpanError):
        ledger.path_of("split", corpus="elsewhere")


def test_metrics_and_history(tmp_path):
    verdict = rounds.should_stop([0.5], 5200)
    for i, rate in ((1, 0.5), (2, 0.4)):
        path = ledger.path_of("itermetrics", tmp_path, iteration=i, **ARM)
        first = ledger.write_metrics(path, scored(rate), RUN, COST, ledger.termination_block(verdict, 5200))
        assert json.loads(path.read_text()) == json.loads(json.dumps(first))
    assert ledger.read_metrics_history(tmp_path, 2, **ARM) == [0.5, 0.4]
    with pytest.raises(SpanError):
        ledger.read_metrics_history(tmp_path, 3, **ARM)


@pytest.mark.parametrize("change", [{"model_id": ""}, {"generated": "today"}, {"tree": "fine"}, {"commit": None}, {"detector": "Q"}])
def test_bad_runs(change):
    with pytest.raises(SpanError):
        ledger.check_run(RUN | change)


def test_bad_blocks():
    block = ledger.termination_block(rounds.not_applicable())
    ledger.check_termination(block)
    for change in ({"converged": True}, {"extra": 1}, {"reason": "tired"}):
        with pytest.raises(SpanError):
            ledger.check_termination(block | change)
    with pytest.raises(SpanError):
        ledger.check_cost(COST | {"llm_calls": 2}, COST)


def test_logs(tmp_path):
    log = tmp_path / "log.md"
    with pytest.raises(SpanError):
        ledger.record_access(log, "es-carmen", "why", ("abc", "clean"))
    log.write_text("| n | at | commit | tree | corpus | fold | arms | purpose |\n|-|-|-|-|-|-|-|-|")
    for bad in ("", "a|b", "a\nb"):
        with pytest.raises(SpanError):
            ledger.record_access(log, "es-carmen", bad, ("abc", "clean"))
    assert ledger.open_sealed(log, "es-carmen", "final numbers", (None, "unknown"), lambda: "rows", callers=(__name__,)) == "rows"
    assert (ledger.count_runs(log), ledger.count_runs(log, "es-carmen"), ledger.count_runs(log, "es-meddocan")) == (1, 1, 0)
    for i in range(2):
        ledger.append_call(tmp_path / "calls.jsonl", {"i": i})
    assert [json.loads(x)["i"] for x in (tmp_path / "calls.jsonl").read_text().splitlines()] == [0, 1]


def test_windows(tmp_path):
    f = tmp_path / "prompt.md"
    f.write_text("one")
    assert ledger.freeze_window(tmp_path / "w.json", [f], False)["revision"] == 1
    assert ledger.freeze_window(tmp_path / "w.json", [f], False)["revision"] == 2
    assert ledger.window_drift(tmp_path / "w.json") == []
    f.write_text("two")
    assert ledger.window_drift(tmp_path / "w.json") == [str(f)]
    with pytest.raises(SpanError):
        ledger.freeze_window(tmp_path / "w.json", [f], True)


def test_log_rows_keep_the_table_together(tmp_path):
    log = tmp_path / "log.md"
    head = "# Log\n\n| n | at | commit | tree | corpus | fold | arms | purpose |\n|-|-|-|-|-|-|-|-|\n"
    log.write_text(head + "| - | - | - | - | - | - | - | - |\n\nText behind the table.\n")
    for i in range(2):
        ledger.record_access(log, "es-carmen", f"run {i}", ("abc", "clean"))
    lines = log.read_text().splitlines()
    assert lines[-2:] == ["", "Text behind the table."] and len(lines) == 8
    assert [x.split("|")[1].strip() for x in lines[4:6]] == ["1", "2"]
    log.write_text("no table\n")
    with pytest.raises(SpanError):
        ledger.record_access(log, "es-carmen", "why", ("abc", "clean"))


def test_only_named_modules_open_the_sealed_fold(tmp_path):
    log = tmp_path / "log.md"
    log.write_text("| n |\n|-|\n")
    with pytest.raises(SpanError):
        ledger.open_sealed(log, "es-carmen", "why", ("abc", "clean"), lambda: "rows")
    assert ledger.count_runs(log) == 0


def test_lines(tmp_path):
    line = ledger.call_line(1, "auditor", {"name": "p", "sha": "0"}, "answer", "ok", {"model_id": "m"}, COST)
    assert line["response_chars"] == 6 and "answer" not in json.dumps(line) and line["sample_reference"] is None
    with pytest.raises(SpanError):
        ledger.call_line(1, "Auditor", {}, "", "ok", {}, COST)
    f = tmp_path / "a"
    f.write_text("x")
    line = ledger.log_line(2, "decision", "none", [f], human_minutes=3, actually_reused=None)
    assert tuple(line) == ledger.LOG_FIELDS and len(line["window"][str(f)]) == 64
    for bad in (("rest", "none", {}), ("decision", "perhaps", {}), ("decision", "none", {"human_minutes": -1}), ("decision", "none", {"colour": 1}), ("decision", "none", {"predicted_scope": "all"})):
        with pytest.raises(SpanError):
            ledger.log_line(1, *bad[:2], **bad[2])


def test_pending_verdict():
    pending = rounds.PendingTermination(5200, (0.5, 0.499))
    assert pending.resolve(0.4985) == rounds.should_stop([0.5, 0.499, 0.4985], 5200) and pending.resolve(0.4985).reason == "converged"
    assert rounds.not_applicable(5200).delta == rounds.delta(5200) and rounds.not_applicable().iterations == 1
