"""Perspectives against rendering turn by turn."""

import pytest

from cohortlens.llm import chat


def esc(text):
    return (text or "").replace("\\", "\\\\").replace("<|", "<\\|")


def slow(turns, part_turns):
    """{(conv, perspective): [(rendered, spans)] per part}"""
    out = {}
    by_conv = {}
    for conv, turn, role, text in turns:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, rows in by_conv.items():
        rows.sort()
        for who in {r[2] for r in rows} - {"system"}:
            parts = {}
            for numbered, turn, role, text in rows:
                part = parts.setdefault((numbered, turn // part_turns if numbered else 0), ["", []])
                if role == "system":
                    head = "<|im_start|>system\n"
                elif role == who:
                    head = "<|im_start|>assistant\n"
                else:
                    head = "<|im_start|>user name=" + esc(role).replace("\n", "\\n") + "\n"
                body = esc(text) + "<|im_end|>"
                if role == who:
                    part[1].append((len(part[0]) + len(head), len(part[0]) + len(head) + len(body)))
                part[0] += head + body + "\n"
            out[conv, who] = [tuple(parts[k]) for k in sorted(parts)]
    return out


def check(df, turns, part_turns=chat.PART_TURNS):
    wanted = slow(turns, part_turns)
    got = {}
    for r in sorted(chat.rotations(df, part_turns=part_turns).collect(), key=lambda r: r.part):
        spans = [tuple(map(int, s.split("-"))) for s in r.mask.split(",") if s]
        before = got.setdefault((r.conv_id, r.perspective), [])
        assert r.start == sum(len(t) for t, _ in before) and r.part == len(before)
        assert r.n_chars == len(r.rendered) and r.n_masked == sum(b - a for a, b in spans)
        assert all(r.rendered[a:b].endswith("<|im_end|>") for a, b in spans)
        before.append((r.rendered, spans))
    assert got == wanted


@pytest.mark.parametrize("part_turns", [1, 3, 256])
def test_table(spark, part_turns):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    check(df, [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()], part_turns)


@pytest.mark.parametrize("part_turns", [2, 256])
def test_several_speakers_and_odd_rows(spark, part_turns):
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|> \\ there"), (1, 2, "bob", "ça va 😀"), (1, 3, "cy\nthe", ""), (1, 4, "ann", None),
        (1, 5, "ann", "twice"), (1, 5, "ann", "twice"), (1, 5, "bob", "same number"), (1, None, "bob", "no number"),
        (2, 0, "system", "nobody speaks"), (3, 0, None, "no name"), (3, 1, "x", "answer"), (None, 0, "x", "no conversation"), (None, 1, None, None),
    ]
    df = spark.createDataFrame([(*t, "a", "b") for t in turns], "conv_id long, turn long, role string, text string, part string, perspective string")
    check(df, turns, part_turns)
    assert chat.rotations(df.limit(0)).count() == 0


def test_large_parts_of_null_and_repeated_numbers_are_cut(spark):
    """A conversation without a key, with null, repeated and equal turns: the parts in order are the text, and none is too large."""
    turns = [(None, None if i % 3 == 0 else i % 2, "ab"[i % 2], f"t{i % 40}") for i in range(200)] + [(1, 0, "a", "x"), (1, 1, "b", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = sorted(chat.rotations(df, part_rows=16).collect(), key=lambda r: r.part)
    assert max(r.n_turns for r in got) == 16
    whole = slow(turns, chat.PART_TURNS)
    for (conv, who), parts in whole.items():
        mine = [r for r in got if (r.conv_id, r.perspective) == (conv, who)]
        text = "".join(t for t, _ in parts)
        assert "".join(r.rendered for r in mine) == text and [r.part for r in mine] == list(range(len(mine)))
        starts = [0]
        for t, _ in parts:
            starts.append(starts[-1] + len(t))
        wanted = [(at + a, at + b) for at, (_, spans) in zip(starts, parts) for a, b in spans]
        assert [tuple(r.start + int(x) for x in s.split("-")) for r in mine for s in r.mask.split(",") if s] == wanted
        assert all(r.n_chars == len(r.rendered) and r.rendered == text[r.start:r.start + r.n_chars] for r in mine)


def test_a_long_dialogue_meets_in_no_task(spark):
    """Places come from lengths: no window sorts rendered texts, however well the turns are numbered."""
    turns = [(1, i, "ab"[i % 2], f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rotated = chat.rotations(df)
    plan = rotated._jdf.queryExecution().executedPlan().toString()
    assert not any("rendered" in line or "pieces" in line for line in plan.splitlines() if "Window" in line)
    check(df, turns)
