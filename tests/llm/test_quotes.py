import re

import pytest

from echogrid.llm import quotes

MARKS = re.compile(r"^(\s?>)+")


def brute(rows):
    """Links, threads and order by plain loops."""
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, role, text or ""))
    out = []
    for conv, messages in by_conv.items():
        lines = [(t, (m := MARKS.match(x)) and m[0].count(">") or 0, " ".join(MARKS.sub("", x).lower().split())) for t, _, text in messages for x in re.split(r"\r?\n", text)]
        origin = {}
        for t, lev, x in lines:
            if not lev and x and t is not None:
                origin[x] = min(t, origin.get(x, t))
        parent, linked = {}, {}
        for turn in {t for t, _, _ in messages if t is not None and conv is not None}:
            votes = {}
            for t, lev, x in lines:
                if t == turn and lev and x in origin and origin[x] < t:
                    votes[lev, origin[x]] = votes.get((lev, origin[x]), 0) + 1
            if votes:
                linked[turn] = sum(votes.values())
                parent[turn] = max(votes, key=lambda k: (-k[0], votes[k], k[1]))[1]
        placed = []
        for turn, role, text in messages:
            depth, top = 0, turn
            while top in parent:
                depth, top = depth + 1, parent[top]
            kept = re.split(r"\r?\n", text)
            own = [x for k, x in enumerate(kept) if not MARKS.match(x) and not (re.search(r"^On .* wrote:$", x) and k + 1 < len(kept) and MARKS.match(kept[k + 1]))]
            n = sum(bool(MARKS.match(x) and MARKS.sub("", x).strip()) for x in kept)
            reply = parent.get(turn, turn - 1 if turn else None)
            placed.append((conv, turn, role, re.sub(r"^\n+|\n+$", "", "\n".join(own)), n, linked.get(turn, 0), reply, top, depth, text))
        key = lambda r: (r[7] is not None, r[7] or 0, r[1] is not None, r[1] or 0, r[2], r[9])
        out += [(*r[:9], k) for k, r in enumerate(sorted(placed, key=key))]
    return sorted(out, key=str)


ROWS = [
    (1, 0, "user", "How are you?\nTell  me more."), (1, 1, "assistant", "Fine."), (1, 2, "user", "On Monday X wrote:\n> how are YOU?\n>> deep line\nthanks"),
    (1, 3, "assistant", "> thanks\n>> How are you?\nwelcome"), (1, 4, "user", "> unknown\nwell"), (1, 5, "user", ">> fine.\n> > thanks\nlast\n\n"), (1, 6, "user", "> welcome\n> last\n> last\nend"),
    (2, 0, "user", "> said by nobody"), (2, 1, "user", None), (2, 2, "user", ""), (2, 2, "user", ""), (2, 5, "user", ">\n > fine.\r\nx"), (None, 1, "user", "a"), (None, 2, "user", "> a"), (3, None, "user", "> a"), (3, 1, "user", "a"),
    *[(4, k, "user", f"line {k}\n> line {k - 1}") for k in range(40)],
    *[(5, k, "user", f"word {k % 3}\n> word {(k + 1) % 3}") for k in range(3000)],
]


@pytest.mark.parametrize("parts", [1, 4])
def test_conversations_match_plain_loops(spark, parts):
    messages = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, body string").repartition(parts)
    assert sorted(map(tuple, quotes.conversations(messages).collect()), key=str) == brute(ROWS)


def test_no_messages(spark):
    assert quotes.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_plan_has_no_python(spark):
    messages = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    plan = quotes.conversations(messages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
