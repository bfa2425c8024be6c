import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessellar.operators import badrows
from tessellar.operators.badrows import diagnose, failing_rows, load_lines, sound_rows

KNOWN = frozenset({"sb", "vdw"})
CASES = [
    ("0\tsb\tA:ARG:1:N\tB:ASP:-2:O", None),
    (" 007 \tSB \tA:ARG:1:N\tB:ASP:-2:O\r", None),
    ('"1"\t"vdw"\t"A:ARG:1:N"\t B:ASP:2:O', None),
    (' "1" \tvdw\tA:ARG:1:N\tB:ASP:2:O', None),
    ("2147483647\tsb\tA:A:1:N\tB:B:2:O", None),
    ("0002147483647\tsb\tA:A:1:N\tB:B:2:O", None),
    ("2147483648\tsb\tA:A:1:N\tB:B:2:O", "frame"),
    ("\tsb\tA:A:1:N\tB:B:2:O", "frame"),
    ("-1\tsb\tA:A:1:N\tB:B:2:O", "frame"),
    ("1.0\tsb\tA:A:1:N\tB:B:2:O", "frame"),
    ("٣\tsb\tA:A:1:N\tB:B:2:O", "frame"),
    ("1\tzz\tA:A:1:N\tB:B:2:O", "interaction_type"),
    ("1\tsb\tA:A:x:N\tB:B:2", "atom1"),
    ("1\tsb\tA:A:1:N\tB:B:2", "atom2"),
    ("1\tsb\tA:A A:1:N\tB:B:2:O", "atom1"),
    ("1\tsb\tA:A:+1:N\tB:B:2:O", "atom1"),
    ("1\tsb\tA:A:1:\tB:B:2:O", "atom1"),
    ("1\tsb\tA:A:1:N\tB:B:2:O\t", "column_count"),
    ("\t1\tsb\tA:A:1:N\tB:B:2:O", "column_count"),
    ("1 sb A:A:1:N B:B:2:O", "column_count"),
    ('1\ts"b\tA:A:1:N\tB:B:2:O', "quoting"),
    ('"1\tsb\tA:A:1:N\tB:B:2:O', "quoting"),
    ('"1"x\tsb\tA:A:1:N', "quoting"),
    ('1\t"s""b"\tA:A:1:N\tB:B:2:O', "interaction_type"),
    ('"1\tsb"\tA:A:1:N\tB:B:2:O', "column_count"),
    ('"1\t"\tsb\tA:A:1:N\tB:B:2:O', None),
    ("1\tsb\tA:A:1:N\tB:B:2:O\v", None),
]


@pytest.mark.parametrize(("line", "reason"), CASES)
def test_diagnosis(line, reason):
    assert diagnose(line, KNOWN)[4] == reason


def test_operator_equals_strict_rule(spark):
    lines = [c[0] for c in CASES] + ["", "  \t ", "# note", ' # "open', None, "x" * 200_000, "1\tsb\tA:A:1:N\tB:B:2:O\r1\tsb\tA:A:1:N\tB:B:2:O"]
    rows = [(i, line, "extra", "extra") for i, line in enumerate(lines * 40)]
    df = spark.createDataFrame(rows, "line_id long, line string, frame string, reason string")
    out = load_lines(df, ["SB", "vdw", None], block=64, leaf=3)
    got = {r["line_id"]: tuple(r)[1:] for r in out.collect()}
    want = {i: diagnose(line, KNOWN) for i, line, *_ in rows if line and line.strip() and not line.strip().startswith("#")}
    assert got == want
    assert sound_rows(out).count() + failing_rows(out).count() == len(want)


def test_empty(spark):
    assert load_lines(spark.createDataFrame([], "line_id long, line string"), []).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet='01sbA:N-\t" \r.', max_size=24), min_size=1, max_size=20))
def test_blocks_agree_with_lines(lines):
    ids, text, known = pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string()), pa.array(sorted(KNOWN))
    got = [tuple(r.values()) for b in badrows.parse_block(ids, text, KNOWN, known, 2) for r in b.to_pylist()]
    assert sorted(got) == [(i, *diagnose(line, KNOWN)) for i, line in enumerate(lines)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=80), st.integers(1, 5))
def test_isolation_keeps_every_doubtful_record(doubt, leaf):
    mask = badrows.isolated(np.array(doubt, bool), leaf)
    assert all(mask[i] for i, d in enumerate(doubt) if d)
    assert leaf > 1 or mask.tolist() == doubt
    assert mask.sum() <= leaf * sum(doubt)
