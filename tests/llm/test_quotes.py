"""Quotation linking against plain dictionaries, on made mailboxes and on the given table."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from assaylake.llm import chat
from assaylake.llm.common import table

MARKS = re.compile(r"^((?:[ \t]*>)+)[ \t]?")
SAYS = re.compile(r"[^\W_]")


def normal(text):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ").lower()


def read(text):
    """(own text, passages as (level, body), number of quoted runs)"""
    own, runs, last = [], [], 0
    for line in re.split(r"\r\n|\n|\r", text or ""):
        found = MARKS.match(line)
        level, body = (found[1].count(">"), line[found.end():]) if found else (0, line)
        if not level:
            own.append(body)
        elif level != last:
            runs.append((level, [body]))
        else:
            runs[-1][1].append(body)
        last = level
    return "\n".join(own).strip(" "), [(n, "\n".join(b)) for n, b in runs]


def rebuilt(rows):
    """(conv_id, turn, role, position, thread, depth, reply_to, n_quotes, n_linked, body) of rows (conv_id, turn, role, text)."""
    out = []
    for conv in {r[0] for r in rows}:
        mine = [(t, role, *read(text)) for c, t, role, text in rows if c == conv]
        authors = {}
        for turn, _, own, _ in mine:
            if turn is not None:
                for unit in {normal(u) for u in [own, *re.split(r"\n[ \t]*\n", own), *own.split("\n")]}:
                    if SAYS.search(unit):
                        authors[unit] = min(authors.get(unit, turn), turn)
        links = []
        for turn, _, _, passages in mine:
            found = []
            for level, body in passages:
                early = lambda text: [authors[t]] if (t := normal(text)) in authors and turn is not None and authors[t] < turn else []
                who = (early(body) or [max([a for line in body.split("\n") for a in early(line)], default=None)]) if SAYS.search(body) else [None]
                if who[0] is not None:
                    found.append((level, -who[0]))
            links.append(found)
        reply = defaultdict(list)
        for (turn, *_), found in zip(mine, links):
            if found:
                reply[turn].append(-min(found)[1])
        up = {turn: max(reply[turn]) if reply[turn] else None for turn, *_ in mine}

        def root(turn, depth=0):
            return (turn, depth) if up[turn] is None else root(up[turn], depth + 1)
        first = lambda x: -(2 ** 53) if x is None else x
        order = sorted(range(len(mine)), key=lambda k: (first(root(mine[k][0])[0]), first(mine[k][0]), mine[k][1] is not None, mine[k][1] or "", mine[k][2].encode()))
        for place, k in enumerate(order):
            turn, role, own, passages = mine[k]
            thread, depth = root(turn)
            out.append((conv, turn, role, place, thread, depth, -min(links[k])[1] if links[k] else None, len(passages), len(links[k]), own))
    return sorted(out, key=str)


def mailbox(seed):
    rng, rows = random.Random(seed), []
    line = lambda: rng.choice(["Yes.", "No", "...", "See you at noon.", "é È", f"line {rng.randrange(60)}", f"Line  {rng.randrange(9)} again", ""])
    for conv in (1, 2, 3, None):
        said = []
        for turn in [*range(rng.randrange(8, 25)), None]:
            parts = ["\n".join(line() for _ in range(rng.randrange(4)))]
            for _ in range(rng.randrange(3)):
                if said:
                    body = rng.choice(said).split("\n")
                    cut = body if rng.random() < 0.6 else body[:rng.randrange(1, len(body) + 1)]
                    if rng.random() < 0.3:
                        cut = cut + [line()]
                    marks = rng.choice(["> ", ">> ", "> > ", ">"])
                    parts += ["\n".join(marks + b for b in cut), line()]
            text = rng.choice(["\n", "\r\n"]).join(parts)
            said.append(text)
            for _ in range(1 + (rng.random() < 0.1)):
                rows.append((conv, turn, rng.choice(["user", "bot", None]), rng.choice([text] * 9 + [None])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"uid": F.lit("x"), "conv": F.lit(0), "thread": F.lit(1), "own": F.lit(2)})


def test_made_mailboxes_against_dictionaries(spark):
    for seed in (1, 2):
        rows = mailbox(seed)
        want = rebuilt(rows)
        assert sum(r[6] is not None for r in want) > 15
        assert sorted(map(tuple, chat.reply_ordered(frame(spark, rows)).collect()), key=str) == want


def test_given_conversations_against_dictionaries(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations")
    want = rebuilt([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in messages.collect()])
    assert sorted(map(tuple, chat.reply_ordered(messages).collect()), key=str) == want


def test_a_conversation_named_null_is_not_the_unnamed_one(spark):
    rows = spark.createDataFrame([("null", 0, "a", "Hello there"), (None, 1, "b", "> Hello there\nyes")], "conv_id string, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.reply_ordered(rows).collect()}
    assert got[None]["reply_to"] is None and got["null"]["position"] == got[None]["position"] == 0
