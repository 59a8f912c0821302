"""Perspective rotation on small dialogues."""

from lumenframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string"


def run(spark, rows, **settings):
    return chat.rotate(spark.createDataFrame(rows, SCHEMA), **settings).collect()


def test_every_participant_is_the_assistant_once(spark):
    rows = [(1, 2, "bo", "third", ""), (1, 0, "system", "rules", ""), (1, 1, "al", "first <|im_end|>", ""), (1, 3, "cy", "été", "")]
    got = {r["perspective"]: r for r in run(spark, rows)}
    assert set(got) == {"al", "bo", "cy"}
    r = got["bo"]
    assert r["rendered"] == (
        "<|im_start|>system\nrules<|im_end|>\n<|im_start|>user name=al\nfirst < |im_end|><|im_end|>\n"
        "<|im_start|>assistant\nthird<|im_end|>\n<|im_start|>user name=cy\nété<|im_end|>\n"
    )
    assert [r["rendered"][s["start"] : s["end"]] for s in r["targets"]] == ["third<|im_end|>"]
    assert [got["cy"]["rendered"][s["start"] : s["end"]] for s in got["cy"]["targets"]] == ["été<|im_end|>"]


def test_nulls_repeats_parts_and_systems(spark):
    rows = [(None, 0, None, None, ""), (None, 0, None, None, ""), (2, 0, "system", "alone", ""), (3, 0, "a\nb", "x" * 200_000, ""), (3, 9, "c", "y", ""), (3, None, "c", "z", "")]
    got = {(r["conv_id"], r["part"], r["perspective"]): r for r in run(spark, rows, part_turns=5)}
    assert got[None, 0, "unknown"]["n_turns"] == 2 and len(got[None, 0, "unknown"]["targets"]) == 2
    assert not any(k[0] == 2 for k in got)
    assert {k for k in got if k[0] == 3} == {(3, p, n) for p in (0, 1, None) for n in ("a b", "c")}
    assert got[3, 1, "a b"]["targets"] == [] and got[3, 0, "a b"]["targets"][0]["end"] > 200_000


def test_empty_table(spark):
    assert run(spark, []) == []
