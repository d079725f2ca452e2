import random

import pytest
from pyspark.sql import functions as F

from runsift.functions.text import decode_text, lines_of, lines_raw_of, trim_ctl
from runsift.functions.tokens import estimate_tokens, savings_pct
from runsift.operators import diffs
from runsift.operators import reduce as R


def test_lines(apply):
    assert apply(lines_of, "") == []
    assert apply(lines_of, "a\n\n") == ["a", ""]
    assert apply(lines_of, "a\r\nb\rc\n") == ["a", "b", "c"]
    assert apply(lines_raw_of, "a\n") == ["a", ""]
    assert apply(trim_ctl, "\x00\t a b \n") == "a b"


def test_ansi_and_carriage_return(apply):
    assert apply(R.ansi_strip, "\x1b[31mred\x1b[0m") == "red"
    assert apply(R.ansi_strip, "10%\r20%\rdone\nnext") == "done\nnext"
    assert apply(R.ansi_strip, "keep\r\nnext") == "keep\r\nnext"
    assert apply(R.last_meaningful_line, "a\nb\n  \n") == "b"


def test_decode_long_line(spark):
    df = spark.createDataFrame([(bytearray(b"abcdefgh\nxy\xff"),)], "b binary")
    assert df.select(decode_text(F.col("b"), 3)).first()[0].replace("�", "?") == "abc\ndef\ngh\nxy?"


def test_head_tail(apply):
    text = "\n".join(map(str, range(1, 8)))
    assert apply(lambda c: R.head_tail(c, 2, 2), text) == "1\n2\n... (3 lines omitted: lines 3..5 of 7) ...\n6\n7"
    assert apply(lambda c: R.head_tail(c, 4, 3), text + "\n") == text + "\n"
    assert apply(lambda c: R.head_tail(c, 1, 0), "a\nb") == "a\n... (1 lines omitted: lines 2..2 of 2) ..."


def test_tail_lines(apply):
    assert apply(lambda c: R.tail_lines(c, 2, True), "a\n\nb\nc\n") == "... (1 lines omitted: lines 1..1 of 3) ...\nb\nc"
    assert apply(lambda c: R.tail_lines(c, 5, False, False), "a\nb") == "... (0 lines omitted: showing all 2 lines) ...\na\nb"


def plain_dedup(lines, window):
    """Restatement on lists: live keys in insertion order, a hit never moves a key."""
    live, out = [], []
    for line in lines:
        key = line.strip()
        hit = next((e for e in live if e[0] == key), None)
        if hit:
            hit[2] += 1
        else:
            entry = [key, len(out), 1]
            out.append((line, entry))
            live = (live + [entry])[-window:]
    return "\n".join(text if e[2] == 1 else f"{text} (×{e[2]})" for text, e in out)


@pytest.mark.parametrize("window", [1, 3, 50])
def test_dedup_matches_restatement(spark, window):
    rng = random.Random(7)
    cases = [[rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(n)] for n in (0, 1, 5, 40, 700)]
    df = spark.createDataFrame([(i, "\n".join(c)) for i, c in enumerate(cases)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", R.deduplicate(F.col("t"), window).alias("v")).collect()}
    assert got == {i: plain_dedup(c, window) for i, c in enumerate(cases)}


def test_dedup_replaces_old_suffix(apply):
    assert apply(R.deduplicate, "x (×3)\nx (×3)") == "x (×2)"


def test_grouping_counts_empty_key(apply):
    assert apply(lambda c: R.grouping(c, "^(a*)b"), "b\nab\nb\nzz") == "    : 2\n  a : 1"
    assert apply(lambda c: R.grouping(c, "^(x)", True), "x\ny\nz") == "  (other) : 2\n  x       : 1"


def test_aggregate_by_key(apply):
    text = "a.py:1\nb.py:2\na.py:3\n\nnope"
    assert apply(lambda c: R.aggregate_by_key(c, "prefix_before_colon", "{lines} in {keys}", 2), text) == "4 in 3\n  a.py: 2\n  b.py: 1"


def test_state_machine_first_match_wins(apply):
    moves = [dict(from_state="A", pattern="x", action="DISCARD", next_state="B"), dict(from_state="A", pattern="xy", action="EMIT", next_state="A")]
    assert apply(lambda c: R.state_machine(c, "A", moves, {"B": "EMIT"}), "xy\nq\nxy") == "q\nxy"
    assert apply(lambda c: R.state_machine(c, "A", moves), "q\nq") == ""


def test_tree_keeps_files_of_implied_directories(apply):
    assert apply(R.tree_compression, "a/b/c/f.txt\na/g.txt") == "a/\n  g.txt\n  b/\n    c/\n      f.txt"
    many = "\n".join(f"d/f{i}" for i in range(9))
    assert apply(R.tree_compression, many) == "d/\n  (9 files)"


def test_json_structure(apply):
    assert apply(R.json_structure, "[]") == "[ ]"
    assert apply(R.json_structure, "not json") == "not json"
    assert '"..."' in apply(R.json_structure, '{"a":' * 8 + "1" + "}" * 8)


def test_search_sample_caps_per_file(apply):
    text = "\n".join(f"f{i % 2}.py:{i}: x" for i in range(60))
    out = apply(R.search_result_sample, text).split("\n")
    assert out[0] == "60 match(es) in 2 file(s)" and out[-1] == "... (36 matches omitted) ..." and len(out) == 26
    assert apply(R.hit_file, "C:\\a.py:3: x") == "C:\\a.py"


def test_tokens(apply):
    assert apply(estimate_tokens, "") == 0
    assert apply(estimate_tokens, "abcde") == 2
    assert apply(estimate_tokens, "ab漢字c") == 4
    assert apply(estimate_tokens, "👍🏽") == 1
    assert apply(estimate_tokens, "é\u0000abcd") == 2
    assert apply(savings_pct, 3, 1) == 66 and apply(savings_pct, 3, 5) == -66 and apply(savings_pct, 0, 5) == 0


def greedy(flags):
    """Line-by-line restatement of the hunk budget."""
    n, keep = len(flags), [False] * len(flags)
    changed = [i for i in range(n) if flags[i]]
    for i in changed if len(changed) <= 60 else changed[:40] + changed[-20:]:
        keep[i] = True
    for gap in (1, 2):
        for i in range(n):
            if keep[i]:
                for j in (i - gap, i + gap):
                    if sum(keep) < 60 and 0 <= j < n and not keep[j] and not flags[j]:
                        keep[j] = True
    top = 0
    for i in range(n):
        if sum(keep) < 60 and top < 40 and not keep[i]:
            keep[i] = True
            top += 1
    for i in reversed(range(n)):
        if sum(keep) < 60 and not keep[i]:
            keep[i] = True
    return [i for i in range(n) if keep[i]]


def test_hunk_positions_match_line_by_line_choice(spark):
    rng, cases = random.Random(5), []
    for k in range(120):
        rate, quiet = rng.choice([0, 0.01, 0.05, 0.3, 0.8]), rng.randint(0, 100)
        cases.append([i >= quiet and rng.random() < rate for i in range(rng.randint(61, 160))])
    df = spark.createDataFrame([(k, ["+" if f else " " for f in c]) for k, c in enumerate(cases)], "k int, b array<string>")
    got = {r.k: r.v for r in df.select("k", diffs.kept_positions(F.col("b")).alias("v")).collect()}
    assert [k for k, c in enumerate(cases) if got[k] != greedy(c)] == []


def test_diff_sample_text(apply):
    body = [f"+line {i}" for i in range(80)]
    out = apply(lambda c: diffs.unified_sample(c), "\n".join(["diff --git a/x b/x", "index 1..2", "@@ -1 +1 @@", *body])).split("\n")
    assert out[:2] == ["diff --git a/x b/x", "@@ -1 +1 @@"]
    assert "... (20 hunk lines omitted) ..." in out and len(out) == 63
    assert apply(lambda c: diffs.diff_summary(c, F.lit("git diff --stat"), F.lit(False), F.lit(0)), " a | 2\n 1 file changed, 2 insertions(+)") == "1 file changed, 2 insertions(+)"
