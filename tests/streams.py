"""Random streams with dense interplay of markers, writes, interrupts, resets and missing times."""

import datetime as dt
import random

from helmline.sources.records import RECORD_SCHEMA

OPERATOR = (
    "Add a retry to src/a.py.", "No, that is not it.", "Only touch src/a.py.",
    "Never edit the release workflow.", "Forget about the release workflow edit.",
    "Forget about the release notes and the workflow edit.",
    "Make sure the tests pass.", "Thanks, looks good.", "Continue.",
    "Again. Make sure the tests pass.", "Stop here and wait for me.",
    "To recap, see task 12.", "New task: fix the parser.",
    "That parser is wrong.", "That parser is wrong, only the parser in scope.", "Fix that parser.",
    "Do not edit the release workflow.", "Never edit the release workflow today.",
    "Never edit the release workflow today again.",
    "I said only touch src/a.py.", "Only touch src/a.py. No longer needed: make sure the tests pass.",
    "You must keep the notes. Keep the notes!", "wrong src/a.py and src/b.py", "plain words here",
    "Keep AB-12 as it is.", "good", "", "```\nnever inside this\n```\nyou must keep going",
    "Disregard that. Disregard the notes you must keep.",
    "x" * 900, "Must keep the notes. " + "long tail " * 90,
)
AGENT = ("Done.", "I also updated the docs.", "Reverted it.", "I opened an issue.", "I added a test.", "")
PATHS = ("src/a.py", "src/b.py", "docs/c.md")


def make(seed, streams=40, length=90, resets=0.02, agents=0.45):
    rng = random.Random(seed)
    rows = []
    for s in range(streams):
        now = dt.datetime(2024, 1, 1)
        pool = rng.sample(OPERATOR, rng.randint(3, len(OPERATOR)))
        share = rng.choice((0.1, agents, 0.7))
        for seq in range(1, rng.randint(2, length) + 1):
            now += dt.timedelta(seconds=rng.choice((1, 30, 600, -40)))
            ts = None if rng.random() < 0.15 else now
            row = dict(stream_id=f"r{s}", turn_id=f"seq-{seq}", seq=seq, ts=ts, speaker="user",
                       speaker_class="human", text="", actions=None, reply_to=None, source=None,
                       metadata=None, sidechain=False, input_mode="")
            p = rng.random()
            if p < share:
                row.update(speaker_class="agent", text=rng.choice(AGENT))
                acts = []
                if rng.random() < 0.5:
                    acts.append(dict(verb="write", targets=rng.sample(PATHS, rng.randint(1, 2)),
                                     argv=[], failed=rng.random() < 0.2))
                if rng.random() < 0.2:
                    acts.append(dict(verb="read", targets=["src/b.py"], argv=[], failed=True))
                row["actions"] = acts
                row["sidechain"] = rng.random() < 0.1
            elif p < share + 0.06:
                row.update(input_mode="interrupt")
            elif p < share + 0.12:
                row.update(speaker_class="tool", text="out",
                           actions=[dict(verb="execute", targets=[], argv=["x"], failed=True)])
            elif rng.random() < resets:
                row["text"] = rng.choice(("Start a new session.", "No. Switch to new session."))
            else:
                row["text"] = "\n".join(rng.sample(pool, rng.choice((1, 1, 2, min(3, len(pool))))))
            rows.append(tuple(row.values()))
    return rows


def frame(spark, *args, **kw):
    return spark.createDataFrame(make(*args, **kw), RECORD_SCHEMA)
