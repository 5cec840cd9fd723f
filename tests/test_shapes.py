"""JSON repair, configurations, sections, families in all shapes, and the interval of exact resampling."""

import hashlib
import json

import numpy as np
import pytest

from siftworks.functions import config, protocols, statistics
from siftworks.operators import bootstrap, sections
from siftworks.sources import records

WHOLE = '{"a": [1, {"b": "x, }] \\" {"}, []], "c": {"d": null}, "e": -1.5e3}'


def parsed(text):
    try:
        return json.loads(text)
    except ValueError:
        return None


def test_cuts_at_every_position_parse_or_are_refused():
    """What is mended holds only what stood there; a cut in a string, a name or behind a comma or colon is refused."""
    kept = 0
    for k in range(1, len(WHOLE) + 1):
        text = WHOLE[:k]
        out = parsed(protocols.repair_json(text))
        if out is not None:
            kept += 1
            assert protocols.repair_json(text).startswith(text)
            assert set(out) <= {"a", "c", "e"}
    assert kept >= 15 and parsed(protocols.repair_json(WHOLE)) == json.loads(WHOLE)


def counted(text):
    """Braces closed by count alone, as for texts without brackets and braces in strings."""
    return text + "}" * max(0, text.count("{") - text.count("}"))


def test_flat_objects_are_mended_as_by_counting():
    for text in ('{"k": 69}', '{"a": {"b": "c"}, "d": true}', '{"x": "y", "n": -10}'):
        for k in range(1, len(text) + 1):
            assert parsed(protocols.repair_json(text[:k])) == parsed(counted(text[:k])), text[:k]


@pytest.mark.parametrize(
    "text, out",
    [
        ('{"a": [1, 2,], }', {"a": [1, 2]}),
        ('```json\n{"a": "x,}"\n```', {"a": "x,}"}),
        ('{"a": "b\\"}', None),
        ('{"a": 1]', None),
        ('{"a": 1}}', None),
        ('{"a": ["}", {"b": [[1', {"a": ["}", {"b": [[1]]}]}),
        ("[1, 2", [1, 2]),
        ("", None),
        (",}", None),
    ],
)
def test_repairs(text, out):
    assert parsed(protocols.repair_json(text)) == out


GOOD = {"schema_version": "1.0.0", "hard_constraint": {"any": [1]}, **dict.fromkeys(config.WEIGHTS, 0.2)}


@pytest.mark.parametrize(
    "change, wanted",
    [
        ({}, []),
        ({"hidden_pass_rate": 0.2 + 1e-10}, []),
        ({"hidden_pass_rate": 0.21}, ["$.composite_score: weights do not sum to 1"]),
        ({"hidden_pass_rate": float("inf")}, ["$.composite_score.hidden_pass_rate: not finite"]),
        ({"hidden_pass_rate": float("nan"), "boundary_pass_at_1": -0.1}, ["$.composite_score.boundary_pass_at_1: outside 0 to 1", "$.composite_score.hidden_pass_rate: not finite"]),
        ({"hidden_pass_rate": True}, ["$.composite_score.hidden_pass_rate: boolean is no number"]),
        ({"schema_version": "1.0.1", "more": 1}, ["$.composite_score.more: unknown", "$.composite_score.schema_version: other version"]),
        ({"hard_constraint": None}, ["$.composite_score.hard_constraint: null is no object"]),
    ],
)
def test_composite_schema(change, wanted):
    assert config.composite_errors({"composite_score": GOOD | change, "other": {}}) == wanted


def test_missing_blocks_and_nested_paths():
    assert config.composite_errors({}) == ["$.composite_score: missing"]
    assert config.composite_errors([]) == ["$: array is no object"]
    assert len(config.composite_errors({"composite_score": {}})) == 7
    rule = config.Rule("object", {"xs": config.Rule("array", items=config.Rule("object", {"n": config.Rule("number"), "s": config.Rule("string", optional=True)}))})
    assert config.errors({"xs": [{"n": 1}, {"n": "1", "s": 2}, 3]}, rule) == ["$.xs[1].n: string is no number", "$.xs[1].s: number is no string", "$.xs[2]: number is no object"]


MARKDOWN = "before\n\n# A\ntext\n## B\n- one\n* two\n  - three \n~~~\n# no\n```\n~~~\n#### C ##\n\nlast\n\n## D\n#no heading\n# E\n```\n## open to the end\n- x"


def test_sections(spark):
    rows = [(1, MARKDOWN), (2, ""), (3, None), (4, "# only"), (5, "\n".join(["# big"] + ["- i"] * 20_000))]
    got = {(r.id, r.section): r for r in sections.sections(spark.createDataFrame(rows, "id bigint, md string"), "id", "md").collect()}
    one = [(got[1, k].level, got[1, k].title, got[1, k].path, got[1, k].body, list(got[1, k].items)) for k in range(6)]
    assert one == [
        (0, "", "", "before", []),
        (1, "A", "A", "text", []),
        (2, "B", "A / B", "- one\n* two\n  - three \n~~~\n# no\n```\n~~~", ["one", "two", "three"]),
        (4, "C", "A / B / C", "last", []),
        (2, "D", "A / D", "#no heading", []),
        (1, "E", "E", "```\n## open to the end\n- x", ["x"]),
    ]
    assert (got[4, 1].title, got[4, 1].body) == ("only", "") and got[2, 0].body == "" and not any(k[0] == 3 for k in got)
    assert len(got[5, 1].items) == 20_000


def test_families_in_all_shapes(spark, tmp_path):
    lines = ['{"families": ["a", {"family_id": "b"}, {"id": "c"}, {"family_id": "", "id": "d"}, {"family_id": 3, "id": "e"}, 7, null, ["x"], {}]}', '{"validation_family_ids": ["a"], "families": null, "train_family_ids": {"no": 1}}', "no JSON", "", '{"frozen_family_ids": ["f", "f"], "train_family_ids": [{"id": "t"}]}', "[1]"]
    (tmp_path / "f.jsonl").write_text("\n".join(lines))
    got = {tuple(r) for r in records.read_family_ids(spark, str(tmp_path / "f.jsonl")).collect()}
    assert got == {("families", x) for x in "abcde"} | {("validation_family_ids", "a"), ("frozen_family_ids", "f"), ("train_family_ids", "t")}


@pytest.mark.parametrize("win, loss, same, low, high", [(86, 40, 450, 0.0417, 0.1181), (35, 49, 492, -0.0556, 0.0069), (72, 33, 471, 0.0330, 0.1024), (26, 49, 501, -0.0694, -0.0104), (112, 41, 423, 0.0816, 0.1649)])
def test_interval_of_exact_resampling(win, loss, same, low, high):
    """The published intervals, within three rows of 576."""
    means = bootstrap.replicate_means(np.array([-1.0, 0.0, 1.0]), np.array([loss, same, win]), 10_000, 42)
    got = means[250], means[9750]
    assert got == pytest.approx((low, high), abs=3 / 576)
    # Replicates have 576 rows each.
    assert np.allclose(means * 576, np.round(means * 576))


def test_exact_resampling_equals_drawing_row_by_row():
    a, b = [0] * 30 + [1] * 70, [1] * 20 + [0] * 30 + [1] * 50
    values, counts = np.unique(np.array(b) - np.array(a), return_counts=True)
    means = bootstrap.replicate_means(values.astype(float), counts, 10_000, 1)
    assert (means[250], means[9750]) == pytest.approx(statistics.bootstrap_interval(a, b, 4_000), abs=0.021)
    assert bootstrap.replicate_means(np.array([0.5]), np.array([9]), 10, 1).tolist() == [0.5] * 10


def test_manifest_of_artifacts(spark, tmp_path):
    files = {"a.jsonl": '{"x": 1}\n\n  \n{"x": 2}\n', "b/c.jsonl/part-0.txt": "1\n2\n3", "b/empty.jsonl": "", "b/blank.jsonl": " \n", "n.md": "é", "b/__pycache__/m.jsonl": "1", ".git/x": "1", "y.pyc": "1", "_SUCCESS": "", "artifact-manifest.json": "{}", "b/x.crc": "1"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = {r.file: (r.folder, r.sha256, r.size, r.row_count) for r in records.artifact_manifest(spark, str(tmp_path)).collect()}
    fact = lambda n: (n.rpartition("/")[0], hashlib.sha256(files[n].encode()).hexdigest(), len(files[n].encode()))
    assert got == {"a.jsonl": (*fact("a.jsonl"), 2), "b/c.jsonl/part-0.txt": (*fact("b/c.jsonl/part-0.txt"), 3), "b/blank.jsonl": (*fact("b/blank.jsonl"), 0), "n.md": (*fact("n.md"), None)}
    assert {r.file for r in records.artifact_manifest(spark, f"file://{tmp_path}", "*.jsonl").collect()} == {"a.jsonl", "b/blank.jsonl"}
