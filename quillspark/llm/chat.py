"""Chat formatting at token level.

Each segment of a conversation (texts and, for unusual roles, the role's name) is encoded by itself,
and reserved ids, which no text can encode to, are spliced in between as turn marks.  The loss mask
covers the texts of assistants and nothing else; it is derived from the segments' lengths by prefix
sums.  So that the decoded form can be parsed as well, control strings that occur in content are
broken by a backslash after their first character, reversibly; an escaped text holds none.

The formatted table has rows (conv_id, part, ids, mask): a conversation is cut into parts between
turns once a part holds PART ids, so that no row grows with the conversation.  Conversations are
brought together by one exchange on conv_id and streamed in turn order; no conversation is held.

Rows: a null text or role counts as empty; turns are ordered by turn, then role and text, null turns
first; repeated rows are repeated turns; a null conv_id is a conversation of its own; an empty
table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import read_ranks
from .shared import by_size, materialize

PART = 1 << 18
# Reserved ids follow the vocabulary in this order.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ANSWER]", "[ROLE]", "[TEXT]")
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("[ANSWER]", "</s>")}
_TO_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Doubles every backslash and puts one after the first character of every control string."""
    return _TO_ESCAPE.sub(lambda m: m.group()[0] + "\\" + m.group()[1:] if len(m.group()) > 1 else "\\\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Template:
    """Assembles turns into ids with a loss mask, and takes them apart again."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.first = max(ranks.values()) + 2  # the id after the vocabulary is kept free
        import public_tokenizers

        self.codec = tiktoken.Encoding("segments", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.id_of = {s: self.first + i for i, s in enumerate(CONTROLS)}

    def turn(self, role: str, text: str) -> list[tuple[list[int], bool]]:
        """Segments of a turn with whether the loss covers them."""
        encode, mark = (lambda x: self.codec.encode_ordinary(escape(x))), self.id_of
        if role in MARKS:
            a, b = MARKS[role]
            return [([mark[a]], False), (encode(text), role == "assistant"), ([mark[b]], False)]
        return [([mark["[ROLE]"]], False), (encode(role), False), ([mark["[TEXT]"]], False), (encode(text), False), ([mark["</s>"]], False)]

    def assemble(self, segments: list[tuple[list[int], bool]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the mask: prefix sums over +1 where a covered segment begins and -1 where it ends."""
        ends = np.cumsum([len(ids) for ids, _ in segments])
        step = np.zeros(int(ends[-1]) + 1, np.int32)
        for (ids, loss), end in zip(segments, ends, strict=True):
            if loss:
                step[end - len(ids)] += 1
                step[end] -= 1
        ids = np.fromiter((x for own, _ in segments for x in own), np.int32, int(ends[-1]))
        return ids, np.cumsum(step)[:-1].astype(np.uint8)

    def text(self, ids: np.ndarray) -> str:
        return self.codec.decode(ids.tolist()) if len(ids) else ""

    def parse(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, str, int]]:
        """(role, text, text under the mask, characters) of each turn; a malformed sequence is an error."""
        at = np.flatnonzero(ids >= self.first)
        name = [CONTROLS[i - self.first] for i in ids[at].tolist()]
        roles = {MARKS[r]: r for r in MARKS}
        k = end = chars = 0
        while k < len(at):
            if at[k] != end:
                raise ValueError("text between turns")
            if name[k] == "<s>":
                chars, k, end = chars + len("<s>"), k + 1, end + 1
                continue
            n = 3 if name[k] == "[ROLE]" else 2
            own = name[k : k + n]
            pieces = [(int(at[k + i]) + 1, int(at[k + i + 1])) for i in range(n - 1)] if len(own) == n else []
            if n == 2 and tuple(own) in roles:
                role = roles[tuple(own)]
            elif own == ["[ROLE]", "[TEXT]", "</s>"]:
                role = unescape(self.text(ids[slice(*pieces[0])]))
            else:
                raise ValueError(f"marks out of order: {own}")
            a, b = pieces[-1]
            raw = self.text(ids[a:b])
            covered = np.flatnonzero(mask[int(at[k]) : int(at[k + n - 1]) + 1]) + int(at[k])
            loss = unescape(self.text(ids[covered]))
            chars += sum(map(len, own)) + len(raw) + sum(len(self.text(ids[slice(*p)])) for p in pieces[:-1])
            yield role, unescape(raw), loss, chars
            chars, end, k = 0, int(at[k + n - 1]) + 1, k + n
        if end != len(ids):
            raise ValueError("text after the last turn")


def _streams(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_chats(turns: DataFrame, path: str) -> DataFrame:
    """Formatted conversations: conv_id, part, ids and mask."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        template = Template(path)
        now, part, held, size = object(), 0, [], 0
        done: list[tuple] = []

        def cut():
            nonlocal held, size, part
            if held:
                ids, mask = template.assemble(held)
                done.append((now, part, ids.tobytes(), mask.tobytes()))
                held, size, part = [], 0, part + 1

        def out():
            cols = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["conv_id", "part", "ids", "mask"])

        for batch in by_size(batches, "text"):
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != now:
                    cut()
                    now, part, held, size = conv, 0, [([template.id_of["<s>"]], False)], 1
                own = template.turn(role, text)
                held += own
                size += sum(len(ids) for ids, _ in own)
                if size >= PART:
                    cut()
            if done:
                yield out()
        cut()
        if done:
            yield out()

    return _streams(rows, "turn", "role", "text").mapInArrow(run, "conv_id long, part long, ids binary, mask binary")


def read_chats(formatted: DataFrame, path: str) -> DataFrame:
    """What formatted conversations say: turns, their digest, the text under the mask, characters."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        template = Template(path)
        now, state = object(), None
        done: list[tuple] = []

        def cut():
            if state is not None:
                n, turns, loss_n, loss, chars, tokens, covered = state
                done.append((now, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars, tokens, covered))

        def out():
            cols = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in by_size(batches, "ids"):
            for conv, raw, cover in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "mask")), strict=True):
                if conv != now:
                    cut()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                ids, mask = np.frombuffer(raw, np.int32), np.frombuffer(cover, np.uint8)
                for role, text, loss, chars in template.parse(ids, mask):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    state[2] += len(loss)
                    state[3].update(loss.encode("utf-8", "surrogatepass"))
                    state[4] += chars
                state[5] += len(ids)
                state[6] += int(mask.sum())
            if done:
                yield out()
        cut()
        if done:
            yield out()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
    return _streams(formatted, "part").mapInArrow(run, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], given.schema)
    return read_chats(materialize(format_chats(given.unionByName(more), path), "chats"), path)
