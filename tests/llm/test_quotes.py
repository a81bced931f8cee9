import random
import re

from emberlattice.scratch import written
from emberlattice.llm.quotes import reply_order

SCHEMA = "conv_id long, turn long, role string, text string, position int"


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return reply_order(df, stored=lambda d: written(d, "quotes"))


def test_links_nested_quotes_and_orders_replies(spark):
    rows = [
        (1, 0, "user", "Shall we meet on Monday?\n\nI can book a room.", 0),
        (1, 1, "assistant", "Yes, at nine.", 0),
        (1, 2, "user", "On Tue, A wrote:\n> I can book a room!\n\nPlease do.", 0),
        (1, 3, "assistant", "> > i can  BOOK a room.\n> Please do.\nDone.", 0),
        (1, 4, "user", ">> never said\nok", 0),
        (2, 0, "user", "> I can book a room.\nElsewhere", 0),
        (1, None, "user", "late", 0), (None, 0, "user", "> late\nlost", 0), (3, 0, "user", None, 0), (3, 1, "user", "", 0), (3, 1, "user", "", 0),
    ]
    got = {(r.conv_id, r.turn, r.position): r for r in run(spark, rows).collect()}
    one = sorted((r for r in got.values() if r.conv_id == 1), key=lambda r: r.position)
    assert [r.turn for r in one] == [0, 2, 3, 1, 4, None]
    assert [r.parent_turn for r in one] == [None, 0, 2, None, None, None]
    assert [r.depth for r in one] == [0, 1, 2, 0, 0, 0]
    assert [r.text for r in one][1:3] == ["Please do.", "Done."]
    assert got[2, 0, 0].n_quotes == 1 and got[2, 0, 0].n_linked == 0
    assert got[None, 0, None].text == "lost"
    assert sorted(k[2] for k in got if k[0] == 3) == [0, 1, 2]
    assert run(spark, []).count() == 0


def brute(rows):
    own, quotes = {}, {}
    norm = lambda x: " ".join(re.findall(r"\w+", x.lower()))
    for c, t, _, text, _ in rows:
        lines = text.split("\n")
        own[c, t] = "\n".join(x for x in lines if not x.startswith(">")).strip()
        runs = []
        for x in lines:
            n = len(x) - len(x.lstrip(">"))
            if n and runs and runs[-1][0] == n:
                runs[-1][1].append(x.lstrip(">"))
            elif n:
                runs.append((n, [x.lstrip(">")]))
            else:
                runs.append((0, []))
        quotes[c, t] = [(n, norm("\n".join(x))) for n, x in runs if n]
    parent = {}
    for c, t in own:
        best = None
        for n, q in quotes[c, t]:
            can = [u for (d, u), x in own.items() if d == c and u < t and q and q in {norm(y) for y in [x, *x.split("\n")]}]
            if can and (best is None or (-n, max(can)) > best):
                best = -n, max(can)
        parent[c, t] = best and best[1]
    def path(c, t):
        return [t] if parent[c, t] is None else [*path(c, parent[c, t]), t]
    return {(c, sorted((u for d, u in own if d == c), key=lambda u: path(c, u)).index(t), t): parent[c, t] for c, t in own}


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = []
    for c in range(30):
        said = []
        for t in range(rng.randrange(1, 25)):
            lines = [" ".join(rng.choices("ab cd ef gh".split(), k=3)) for _ in range(rng.randrange(1, 3))]
            quoted = [">" * rng.choice([1, 1, 2]) + rng.choice(said) for _ in range(rng.randrange(0, 3))] if said else []
            said += lines
            rows.append((c, t, "user", "\n".join([*quoted, *lines]), 0))
    got = {(r.conv_id, r.position, r.turn): r.parent_turn for r in run(spark, rows).collect()}
    assert got == brute(rows)


def test_partial_quotes_of_several_lines(spark):
    long = "One is here.\nTwo is there.\nThree is gone.\n\nA second\nparagraph.\n\nThe third one.\nIts end."
    rows = [
        (1, 0, "user", long, 0),
        (1, 1, "user", "Two is there.\nOther words.", 0),
        (1, 2, "user", "> Two is there.\n> Three is gone.\nLines of a paragraph.", 0),
        (1, 3, "user", "> A second paragraph.\n>\n> The third one. Its\n> end.\nTwo paragraphs, wrapped anew.", 0),
        (1, 4, "user", "> One is here. Two is there. Three is gone.\n>\n> The third one.\nFirst and third, cut.", 0),
        (1, 5, "user", "> Three is gone.\n> Two is there.\nWrong order.", 0),
        (1, 6, "user", "> Two is there.\n> Two is there.\nSaid once.", 0),
        (1, 7, "user", "> Three is gone.\n> Other words.\nTwo messages.", 0),
        (1, 8, "user", "Three is gone.\nTwo is there.\nSome.", 0),
        (1, 9, "user", "> Two is there.\n> Three is gone.\nA later message has both, in another order.", 0),
        (1, 10, "user", "> Three is gone.\n> Two is there.\nThat order now.", 0),
        (2, 1, "user", "> Two is there.\n> Three is gone.\nElsewhere.", 0),
        (1, 11, "user", "> Other words.\nTwice the row.", 0), (1, 11, "user", "> Other words.\nTwice the row.", 0),
    ]
    got = run(spark, rows).collect()
    parent = {(r.conv_id, r.turn): r.parent_turn for r in got}
    want = {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 0, (1, 4): 0, (1, 5): None, (1, 6): None, (1, 7): None, (1, 8): None, (1, 9): 0, (1, 10): 8, (2, 1): None, (1, 11): 1}
    assert parent == want
    assert all(r.n_linked == (r.parent_turn is not None) for r in got) and len(got) == len(rows)
