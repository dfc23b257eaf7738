import pytest

pref = pytest.importorskip("galaxis.llm.preference")
PAIRS = "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, status int"


def render(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)


def learned(text, mask):
    """The parts of a completion that its mask marks."""
    out, at = [], 0
    for run in filter(None, mask.split(",")):
        n, flag = map(int, run.split(":"))
        if flag:
            out.append(text[at : at + n])
        at += n
    assert at == len(text)
    return out


def test_prefix_completions_and_masks(spark):
    u, a, b = ("user", "Hi é"), ("assistant", "one 😀"), ("assistant", "two\nlines")
    long = [("user" if i % 2 else "assistant", f"turn {i}") for i in range(300)]
    cases = [([u, a], [u, b]), ([u, a], [u, a]), ([u, a], [u, a, u, b]), ([u], []), ([], []), ([a, u], [u, a]), ([(None, None), a], [("", ""), b]), (long, long[:299] + [b]), ([u], None), (None, [u])]
    rows = [(i, c, r, 7) for i, (c, r) in enumerate(cases)]
    got = {x.id: x for x in pref.formatted(spark.createDataFrame(rows, PAIRS)).collect()}
    for i, (c, r) in enumerate(cases):
        x = got[i]
        if c is None or r is None:
            assert (x.status, x.prompt, x.chosen_text, x.rejected_mask) == ("unpaired", None, None, None)
            continue
        clean = lambda turns: [(p or "", q or "") for p, q in turns]
        c, r = clean(c), clean(r)
        k = next((k for k in range(max(len(c), len(r))) if c[k : k + 1] != r[k : k + 1]), len(c))
        assert (x.n_prompt_turns, x.prompt, x.chosen_text, x.rejected_text) == (k, render(c[:k]), render(c[k:]), render(r[k:]))
        assert x.status == ("identical" if c == r else "paired")
        for side, text, mask in ((c, x.chosen_text, x.chosen_mask), (r, x.rejected_text, x.rejected_mask)):
            assert learned(text, mask) == [t + "<|end|>\n" for role, t in side[k:] if role == "assistant"]


def test_reply_pairs(spark):
    rows = [(4, 1, "assistant", "x"), (4, 0, "user", "q"), (5, 0, "user", "p"), (5, 1, "assistant", "y"), (5, 1, "assistant", "y"), (9, 0, "user", "alone"), (None, 0, "user", "lost"), (-1, None, "user", "m"), (-2, 3, "user", "n")]
    got = {r.conv_id: (r.chosen, r.rejected) for r in pref.reply_pairs(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    text = lambda turns: turns and [t.text for t in turns]
    assert {k: (text(c), text(r)) for k, (c, r) in got.items()} == {4: (["q", "x"], ["q", "y"]), 5: (["p", "y", "y"], ["p", "y", "x"]), 9: (["alone"], None), -1: (["m"], ["n"]), -2: (["n"], ["m"])}
    assert pref.formatted(pref.reply_pairs(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))).count() == 0
