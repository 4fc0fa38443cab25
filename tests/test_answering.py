"""Answer turns with generators that fail, give up and repeat themselves, turn by turn."""

from __future__ import annotations

import pytest

from quillspark.operators import answering as A
from quillspark.operators import generation as G

SCHEMA = "turn_id long, question string, history array<struct<role:string,text:string>>"
DOCS = [(1, "ant facts"), (2, "bee facts"), (3, None), (4, "bee lies")]


def rule():
    """The generator as a local function, which Spark's workers get by value."""

    def by_rule(prompts: list[str]) -> list[str | None]:
        """Fails for a list that holds 'boom'; condenses to the last word, and so on."""
        out: list = []
        for p in prompts:
            if "boom" in p:
                raise RuntimeError("boom")
            if p.startswith("Conversation:"):
                out.append("" if "blank" in p else p.split(" ")[-1])
            elif "\nPassage: " in p:
                out.append("no" if "lies" in p or "strict" in p else "maybe so")
            elif p.startswith("Rewrite: "):
                out.append({"strict gnu": "bee", "zebra": "zebra", "yak": None}.get(p[9:], "ant"))
            elif p.startswith("Answer: "):
                out.append("UNGROUNDED" if "wild" in p else "grounded." if "calm" in p else "?")
            else:
                out.append("calm" if p.endswith(A.AGAIN) and "ant" not in p else "wild" if "facts" in p else " ")
        return out

    return by_rule


def retrieve(asked):
    docs = asked.sparkSession.createDataFrame(DOCS, "id long, text string")
    hits = asked.crossJoin(docs.withColumnRenamed("text", "body")).filter("exists(split(text, ' '), w -> body like concat('%', w, '%')) or (text = 'null' and body is null)")
    return hits.selectExpr("query_id", "id", "body as text", "int(id) as rank")


def run(spark, rows, **more):
    steps = A.Steps(*[rule()] * 5, **more)
    got = A.answer_turns(spark.createDataFrame(rows, SCHEMA), retrieve, steps).collect()
    return {r["turn_id"]: (r["outcome"], r["answer"], r["generations"], [(a["query"], a["found"], a["kept"]) for a in r["attempts"] or []], r["failure"]) for r in got}


def test_turns(spark):
    told = [("user", "tell me [1]"), ("assistant", "of ants")]
    rows = [
        (1, "bee", None), (2, "and more on bee", told), (3, "blank ant", told), (4, "boom bee", told), (5, "strict gnu", []), (6, "zebra", None), (7, "yak", None), (8, "null", None), (9, "ant", None), (10, "lies", None),
    ]
    got = run(spark, rows)
    bee = [("bee", 2, ["2"])]
    assert got[1] == got[2] == ("answered", "calm", 2, bee, None)
    # What can't be condensed is asked as it is.
    assert got[3] == ("ungrounded", "wild", 2, [("blank ant", 1, ["1"])], None)
    # A failure while grading keeps the passages, and one while generating is the outcome.
    assert got[4][0] == "failed" and got[4][3] == [("boom bee", 2, ["2", "4"])] and "boom" in got[4][4] and got[4][2] == 1
    assert got[5] == ("answered", "calm", 2, [("strict gnu", 0, []), ("bee", 2, ["2"])], None)
    # A rewriting that says the same, or nothing, ends the attempts.
    assert got[6] == ("nothing_found", None, 0, [("zebra", 0, [])], None) and got[7] == ("nothing_found", None, 0, [("yak", 0, [])], None)
    assert got[8] == ("failed", None, 1, [("null", 1, ["3"])], "no text")
    assert got[9] == ("ungrounded", "wild", 2, [("ant", 1, ["1"])], None)
    assert got[10] == ("ungrounded", "wild", 2, [("lies", 1, []), ("ant", 1, ["1"])], None)


def test_bounds(spark):
    assert run(spark, [(10, "lies", None)], attempts=1) == {10: ("graded_out", None, 0, [("lies", 1, [])], None)}
    assert run(spark, [(1, "bee", None)], regenerations=0) == {1: ("ungrounded", "wild", 1, [("bee", 2, ["2"])], None)}
    assert run(spark, []) == {}


@pytest.mark.parametrize("bad", [[], [3], [0, 6], list(range(7))])
def test_failures_stand_alone(bad):
    """Only prompts that fail by themselves have no reply; too few replies are a failure."""
    asked: list = []

    def generate(prompts):
        asked.append(len(prompts))
        if any(int(p) in bad for p in prompts):
            raise ValueError("bad")
        return prompts

    got = G.replies([str(i) for i in range(7)], generate)
    assert got == [(None, "ValueError: bad") if i in bad else (str(i), None) for i in range(7)] and len(asked) <= 13
    assert G.replies(["a", "b"], lambda p: p[:1] if len(p) > 1 else ["x"]) == [("x", None), ("x", None)] and G.replies([], generate) == []
