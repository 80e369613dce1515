r"""Chat formatting: budgeted, turn-aligned windows over conversations.

A conversation becomes one or more training texts ("windows"). Prefix sums of the
turns' token counts choose spans of whole turns that fit a budget; a turn counts for
its text, at least a token for each ``TOKEN_CHARS`` characters, and ``TURN_TOKENS`` for
its role and marks. Every window after that with the system turn repeats this turn,
always and whole, and the last turns before its span, up to a limit and as far as the
budget goes; what is repeated is masked, so each assistant text is a target once.

Template: ``<turn role>`` newline, text, ``</turn>`` newline. Inside roles and
texts ``\`` becomes ``\b``, ``<`` becomes ``\l`` and ``>`` becomes ``\g``, so no
text can hold a mark, and the escape is reversible.

Rows of a conversation are sorted across the shuffle (with spilling) and stream
through a task. A task holds a window, its history and the system turn, never a
conversation: windows and history are bounded in turns, as every turn counts. One
conversation's turns pass one task, as their digest is sequential.

Defined cases: null text or role counts as empty; rows with the same turn are
ordered by role and text; a null turn comes first; rows whose conv_id is null
form one conversation; a turn over the budget gets a window of its own, with the
system turn; the first system turn is the one that is retained; repeated rows stay; other columns are ignored; no rows give no windows.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_schema

#: Production parameters: tokens in a window, and of history repeated in one.
BUDGET, HISTORY = 1024, 256
#: A rough token: a run of letters and digits of any script or a single other sign.
TOKEN = r"(?U)\w+|[^\w\s]"
#: Characters for which a token counts at least, and tokens of a turn's role and marks.
TOKEN_CHARS, TURN_TOKENS = 8, 4

WINDOWS = "conv_id bigint, window_id bigint, n_turns bigint, n_repeated bigint, n_tokens bigint, text string, loss_starts array<bigint>, loss_ends array<bigint>"
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"


def escape(s: str) -> str:
    return s.replace("\\", "\\b").replace("<", "\\l").replace(">", "\\g")


def unescape(s: str) -> str:
    return s.replace("\\g", ">").replace("\\l", "<").replace("\\b", "\\")


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where its escaped text starts and ends in it."""
    head, body = f"<turn {escape(role)}>\n", escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def parse(window: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    turns = []
    for part in window.split("<turn ")[1:]:
        head, _, rest = part.partition(">\n")
        turns.append((unescape(head), unescape(rest[: rest.rindex("</turn>")])))
    return turns


class _Window:
    """The window being filled, and what later windows of the conversation repeat."""

    def __init__(self, conv, budget: int, history: int, targets: frozenset) -> None:
        self.conv, self.budget, self.history, self.targets = conv, budget, history, targets
        self.id, self.prefix, self.floor = 0, 0, 0  # tokens of all turns so far, and of those before this window's span
        self.system: tuple | None = None
        self.recent: deque[tuple] = deque()  # the last turns, at most `history` tokens of them
        self.held = self.kept = 0  # tokens of what is repeated, and of the last turns
        self.repeated: list[tuple] = []
        self.span: list[tuple] = []

    def _repeat(self, tokens: int) -> None:
        """Choose what the next window repeats beside a first turn of so many tokens: the system turn, and what fits of the last ones."""
        last, room = [], self.budget - tokens - (self.system[2] if self.system else 0)
        for turn in reversed(self.recent):
            if turn is not self.system:
                room -= turn[2]
                if room < 0:
                    break
                last.append(turn)
        self.repeated = ([self.system] if self.system else []) + last[::-1]
        self.held = sum(t for *_, t in self.repeated)

    def add(self, role: str, text: str, tokens: int):
        """Append a turn; gives the finished window if the turn does not fit it."""
        done = None
        if self.span and self.held + self.prefix + tokens - self.floor > self.budget:
            done = self.close()
            self._repeat(tokens)
            self.floor = self.prefix
        turn = (role, text, tokens)
        if self.system is None and role == "system":
            self.system = turn
        self.span.append(turn)
        self.prefix += tokens
        self.recent.append(turn)
        self.kept += tokens
        while self.kept > self.history:
            self.kept -= self.recent.popleft()[2]
        return done

    def close(self):
        out, at, starts, ends = [], 0, [], []
        for k, (role, text, _) in enumerate(self.repeated + self.span):
            turn, a, b = render(role, text)
            if k >= len(self.repeated) and role in self.targets:
                starts.append(at + a)
                ends.append(at + b)
            out.append(turn)
            at += len(turn)
        tokens = self.held + self.prefix - self.floor
        row = (self.conv, self.id, len(self.repeated) + len(self.span), len(self.repeated), tokens, "".join(out), starts, ends)
        self.id, self.span = self.id + 1, []
        return row


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, targets: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Windows of all conversations; each conversation's in order within a partition."""
    schema, aims = arrow_schema(WINDOWS), frozenset(targets)
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), role.alias("role"), text.alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    tokens = F.greatest(F.regexp_count("text", F.lit(TOKEN)), F.ceil(F.length("text") / TOKEN_CHARS)) + TURN_TOKENS
    rows = rows.select("conv_id", "role", "text", tokens.cast("bigint").alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Window | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                done = []
                for conv, role, text, tokens in zip(*(c.to_pylist() for c in batch.slice(at, 2048).columns)):
                    if now is None or conv != now.conv:
                        if now is not None:
                            done.append(now.close())
                        now = _Window(conv, budget, history, aims)
                    if row := now.add(role, text, tokens):
                        done.append(row)
                if done:
                    yield _columns(done, schema)
        if now is not None:
            yield _columns([now.close()], schema)

    return rows.mapInArrow(run, WINDOWS)


def digest_windows(windows: DataFrame) -> DataFrame:
    """What can be read back from formatted windows, a row per conversation.

    Expects each conversation's windows in order within one partition, as
    :func:`format_conversations` leaves them.
    """
    schema = arrow_schema(DIGEST)

    class State:
        def __init__(self, conv) -> None:
            self.conv, self.n, self.chars, self.total, self.windows = conv, 0, 0, 0, 0
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, repeated: int, text: str, starts: list[int], ends: list[int]) -> None:
            for role, body in parse(text)[repeated:]:
                self.turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                self.n += 1
            for a, b in zip(starts, ends):
                target = unescape(text[a:b])
                self.loss.update(target.encode("utf-8", "surrogatepass"))
                self.chars += len(target)
            self.total += len(text)
            self.windows += 1

        def row(self) -> tuple:
            return (self.conv, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.total, self.windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: State | None = None
        for batch in batches:
            done = []
            for conv, repeated, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = State(conv)
                now.add(repeated, text, starts, ends)
            if done:
                yield _columns(done, schema)
        if now is not None:
            yield _columns([now.row()], schema)

    return windows.select("conv_id", "n_repeated", "text", "loss_starts", "loss_ends").mapInArrow(run, DIGEST)
