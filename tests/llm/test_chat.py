import hashlib
import random

import pytest

from baitline.llm import chat
from baitline.llm.queries import chat_digests

SCHEMA = "conv_id bigint, turn bigint, role string, text string, fp int"


def brute(rows):
    talks = {}
    for c, t, r, x, *_ in rows:
        talks.setdefault(c, []).append(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or "")))
    out = {}
    for c, turns in talks.items():
        turns = [(r[1], x[1]) for _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(),
                  len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(spark, rows, template=None):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r.conv_id: r for r in chat.format_digests(df, template).collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    parts = ["<|im_end|>", "<|im_start|>assistant ", "\\", "<\\|", "<", "|", "n", "\n", "ok ", "é😀", "A", "B", "\\n", ""]
    out = []
    for c in range(30):
        for t in range(rng.randrange(1, 9)):
            out.append((c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choices(parts, k=6)), 1))
    out += [(50, t, "assistant" if t % 2 else "user", f"turn {t} " + "x" * (t % 7), 1) for t in range(150)]
    out += [(51, 0, "assistant", None, 1), (51, 1, None, "text", 1), (51, None, "user", "first", 1),
            (52, 0, "assistant", "tie", 1), (52, 0, "assistant", "tie", 1), (52, 0, "a\nb<|", "odd role", 1),
            (None, 0, "assistant", "no id", 1), (53, 0, "assistant", "", 1), (54, 0, "user", "y" * 100_000, 1)]
    return out


def test_against_brute_force(spark, rows):
    got = digests(spark, rows)
    want = brute(rows)
    assert set(got) == set(want)
    for c, r in got.items():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want[c], c
        assert not r.rewrites
    whole = chat.EscapedTemplate()
    talk = sorted((t, r, x) for c, t, r, x, _ in rows if c == 7)
    assert got[7].formatted_chars == len(whole.render([(r, x) for _, r, x in talk]))
    assert got[50].formatted_chars == len(whole.render([(r, x) for c, t, r, x, _ in rows if c == 50]))
    assert digests(spark, rows[:0] or [(1, 0, "user", "x", 1)])[1].n_turns == 1
    assert chat.format_digests(spark.createDataFrame([], SCHEMA)).count() == 0


class Rewriting(chat.EscapedTemplate):
    """Writes the number of turns in front: every turn changes what was there."""

    def render(self, turns):
        return f"{len(turns)}:" + super().render(turns)


class Numbered(chat.EscapedTemplate):
    """Appends only, but a turn depends on how many came before."""

    def render(self, turns):
        return "".join(f"{i}{super(Numbered, self).render([t])}" for i, t in enumerate(turns))


def test_templates_that_rewrite_history_are_reported():
    talk = chat.Conversation(Rewriting())
    for i in range(3):
        talk.add("user", f"text {i}")
    assert talk.rewrites


def test_prefix_is_kept_where_the_template_needs_it():
    for template, kept in ((Numbered(), 200), (chat.EscapedTemplate(), chat.CONTEXT)):
        talk, turns = chat.Conversation(template), []
        for i in range(200):
            turns.append(("user", f"<{i}>"))
            rendered, start, lo, hi = talk.add(*turns[-1])
            whole = template.render(turns)
            assert whole[start:] == rendered and template.unescape(whole[lo:hi]) == f"<{i}>"
        assert talk.length == len(whole) and not talk.rewrites and len(talk.turns) <= kept


def test_query(spark, sf):
    rows = [tuple(r) + (0,) for r in spark.read.parquet(f"{sf}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    want = brute(rows + [(-1, 0, "user", said, 0), (-1, 1, "assistant", said, 0)])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
           for r in chat_digests(spark, sf).collect()}
    assert got == want


class ForgetsAfterForty:
    """Drops the turns before the last 40."""

    def render(self, turns):
        return "".join(f"<{role}>{text}</>" for role, text in turns[-40:])


def test_late_rewrite_is_reported():
    talk = chat.Conversation(ForgetsAfterForty())
    seen = [talk.add("user", f"turn {i}") and talk.rewrites for i in range(45)]
    assert seen == [False] * 40 + [True] * 5


class Misdeclared(chat.EscapedTemplate):
    """Says that it only appends, but counts the turns beyond 40 in front."""

    append_only = True

    def render(self, turns):
        return f"{len(turns)}:" * (len(turns) > 40) + super().render(turns)


class Watched(chat.EscapedTemplate):
    append_only = True

    def __init__(self):
        self.sizes = []

    def render(self, turns):
        self.sizes.append(len(turns))
        return super().render(turns)


def test_every_prefix_is_rendered_whole():
    """Three renderings of each prefix, however long it is and whatever the template declares."""
    talk = chat.Conversation(Watched())
    for i in range(100):
        talk.add("user", f"turn {i}")
    assert talk.template.sizes == [n for n in range(1, 101) for _ in range(3)]
    talk = chat.Conversation(Misdeclared())
    seen = [talk.add("user", f"turn {i}") and talk.rewrites for i in range(45)]
    assert seen == [False] * 40 + [True] * 5


def test_shared_prefix():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ("".join(rng.choices("ab", k=rng.randrange(12))) for _ in range(2))
        want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert chat._shared(a, b) == want
