"""Preference pairs on hand-made conversations."""

from foldwise.llm import preference

SCHEMA = "pair_id long, turn long, role string, text string, n_prompt_turns int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)


def test_pairs(spark):
    chosen = [
        (1, 1, "assistant", "fine"),
        (1, 0, "user", "hi"),
        (2, 0, "user", "same"),
        (3, 0, "user", "x" * 20_000),
        (4, 0, None, None),
        (4, 0, None, None),
        (None, 0, "user", "q"),
        (6, 0, "assistant", "alone"),
    ]
    rejected = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", "no\n"),
        (1, 2, "assistant", ""),
        (2, 0, "user", "same"),
        (3, 0, "user", "y"),
        (4, 0, "", ""),
        (None, 0, "user", "q"),
    ]
    rows = {r["pair_id"]: r for r in preference.format_preferences(frame(spark, chosen), frame(spark, rejected)).collect()}
    assert len(rows) == 6
    one = rows[1]
    assert one["n_prompt_turns"] == 1 and one["prompt"] == "<|user|>\nhi<|end|>\n"
    assert one["chosen"] == "<|assistant|>\nfine<|end|>\n"
    cut = lambda side: [one[side][s["start"] : s["end"]] for s in one[f"{side}_mask"]]
    assert cut("chosen") == ["fine<|end|>"] and cut("rejected") == ["no\n<|end|>", "<|end|>"]
    assert rows[2]["chosen"] == rows[2]["rejected"] == "" and rows[2]["chosen_mask"] == []
    assert rows[3]["n_prompt_turns"] == 0 and len(rows[3]["chosen"]) > 20_000
    assert rows[4]["n_prompt_turns"] == 1 and rows[4]["chosen"] == "<||>\n<|end|>\n"
    assert rows[None]["n_prompt_turns"] == 1
    assert rows[6]["prompt"] == "" and rows[6]["rejected"] == ""


def test_empty(spark):
    empty = frame(spark, [(1, 0, "user", "x")]).limit(0)
    assert preference.format_preferences(empty, empty).count() == 0
