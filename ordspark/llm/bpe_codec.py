"""Byte-level BPE as a lazily determinised finite-state transducer.

The merges are compiled into a nondeterministic transducer: a configuration is
the tokens passed so far and the bytes read of the next token.  A token may
follow another only if merging could not have crossed the border between them;
this is decided from the two tokens' own derivations, so a sequence whose
neighbours all fit is the library's encoding, and every prefix of a text has
exactly one.  Subset construction makes it deterministic while texts are read:
a state holds the configurations that are still alive, each with the tokens it
does not share with the others.  Tokens are outputs of transitions: what all
configurations of a target begin with is emitted on the way to it, so a token
leaves as soon as the living configurations agree on it, and the lookahead is
bounded by the longest token that can still be completed.  States and
transitions are remembered and forgotten together when there are too many.

Decoding joins the tokens' bytes and passes them through an incremental UTF-8
machine that holds back an unfinished character until its last byte arrives.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, keep, slices
from .pretokens import PATTERN, Memo, splitter

_NEVER = 1 << 62


def read_ranks(source: bytes) -> dict[bytes, int]:
    """bytes -> rank of a rank file: a line holds a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, source.splitlines()) if token}


class State(dict):
    """A state: byte -> (next state, tokens emitted on the way), filled as bytes are read.

    ``configurations`` are the living ones, oldest first: (token passed last,
    node of the token trie reached since then, tokens passed but not yet
    emitted).  The last of them has just passed a token, so ``rest``, what it
    has not emitted, completes the encoding of a piece that ends here.
    """

    __slots__ = ("configurations", "rest", "owner")

    def __init__(self, owner: Transducer, configurations: tuple):
        self.owner, self.configurations, self.rest = owner, configurations, configurations[-1][2]

    def __missing__(self, byte: int) -> tuple[State, tuple[int, ...]]:
        arc = self[byte] = self.owner.arc(self, byte)
        return arc


class Transducer:
    """ids of one piece, byte by byte.  ``most`` bounds the remembered states.

    Configurations carry the tokens they do not share yet.  An arc takes every
    configuration over a byte, drops those that die, adds the one that passes a
    token, and emits what all of them then begin with.
    """

    def __init__(self, ranks: dict[bytes, int], most: int = 320_000):
        self.ranks, self.most = ranks, most
        self.spelled = {rank: token for token, rank in ranks.items()}
        self.next: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                step = node << 8 | byte
                node = self.next.get(step, 0)
                if not node:
                    node = self.next[step] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = rank
        self.spines: dict[int, tuple | None] = {}
        self.fits: dict[int, bool] = {}
        self.states: dict[tuple, State] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states; one in use goes on with arcs to new ones."""
        self.states.clear()
        start = ((-1, 0, ()),)
        self.start = self.states[start] = State(self, start)

    # -- which tokens may stand side by side

    def _derivation(self, token: int):
        """(left edges, right edges) of a token's own merging: the pieces that
        stood at its edge with the rank of the merge that ended each.  None if
        merging its bytes does not give the token."""
        if token in self.spines:
            return self.spines[token]
        text, ranks = self.spelled[token], self.ranks
        parts = [text[i : i + 1] for i in range(len(text))]
        left, right = [], []
        while len(parts) > 1:
            rank, at = min(((ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1)))
            if rank == _NEVER:
                break
            if at == 0:
                left.append((parts[0], rank))
            if at == len(parts) - 2:
                right.append((parts[-1], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        found = None if len(parts) > 1 else ([*left, (text, _NEVER)], [*right, (text, _NEVER)])
        self.spines[token] = found
        return found

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border when b's bytes follow a's."""
        if len(self.fits) > 4 * self.most:
            self.fits.clear()
        good = self.fits[a << 32 | b] = self._derivation(b) is not None and self._check(a, b)
        return good

    def _check(self, a: int, b: int) -> bool:
        right, left = self._derivation(a)[1], self._derivation(b)[0]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = right[i], left[j]
            rank = self.ranks.get(x + y, _NEVER)
            # at equal ranks the merge that stands further left comes first
            if rank < x_ends and rank <= y_ends and rank != _NEVER:
                return False
            if x_ends == y_ends == _NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    # -- determinisation

    def arc(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """(next state, emitted tokens) of a state that has not read this byte before."""
        step, ends, fits = self.next.get, self.ends, self.fits
        living, passing = [], None
        for last, node, held in state.configurations:
            node = step(node << 8 | byte)
            if node is None:
                continue
            living.append((last, node, held))
            if passing is None and (token := ends[node]) >= 0:
                if last < 0:
                    good = self._derivation(token) is not None
                elif (good := fits.get(last << 32 | token)) is None:
                    good = self._may_follow(last, token)
                if good:
                    passing = (token, 0, (*held, token))
        if passing is None:
            raise ValueError("the ranks do not cover every byte")
        living.append(passing)
        emitted = living[0][2]
        if emitted:  # the oldest holds back something: what all others begin with too leaves
            for _, _, held in living:
                if held is not emitted:
                    same = 0
                    for x, y in zip(emitted, held):
                        if x != y:
                            break
                        same += 1
                    emitted = emitted[:same]
            if sure := len(emitted):
                living = [(last, node, held[sure:]) for last, node, held in living]
        key = tuple(living)
        target = self.states.get(key)
        if target is None:
            if len(self.states) >= self.most:
                self.reset()
            target = self.states[key] = State(self, key)
        return target, emitted

    def encode(self, piece: bytes) -> tuple[int, ...]:
        state, out = self.start, []
        for byte in piece:
            state, emitted = state[byte]
            if emitted:
                out += emitted
        out += state.rest
        return tuple(out)


class Utf8Machine:
    """Incremental UTF-8: ``feed`` returns the characters finished so far and
    holds back the bytes of an unfinished one (three at most).  Bytes that can
    never become a character give U+FFFD."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2 if byte >= 0xC0 else 1
            keep = back if need > back else 0
            break
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        left, self.held = self.held, b""
        return left.decode("utf-8", "replace")


class Codec:
    """Encoding and decoding of whole texts by a rank file's bytes."""

    def __init__(self, source: bytes, pattern: str = PATTERN, remembered: int = 250_000):
        self.transducer = Transducer(read_ranks(source))
        self.spelled = self.transducer.spelled
        self.split = splitter(pattern)
        self.digits = {rank: b"%d" % rank for rank in self.spelled}
        self.known = Memo(lambda piece: self.transducer.encode(piece.encode()), remembered)
        self.written = Memo(self._write, remembered)

    def _write(self, piece: str) -> tuple[bytes, bytes]:
        """(decimal ids joined by spaces, bytes that the ids decode to) of a piece."""
        ids = self.transducer.encode(piece.encode())
        return b" ".join([self.digits[i] for i in ids]), b"".join([self.spelled[i] for i in ids])

    def digests(self, text: str, kept: list | None = None) -> tuple[int, str, str, bool]:
        """(number of ids, SHA-256 of the decimal ids joined by spaces, SHA-256 of
        the decoded text, whether it is the text), part by part.  ``kept`` takes
        the ids, an int32 array for each part."""
        look, machine = self.written.__getitem__, Utf8Machine()
        ids_sha, text_sha, n, at, same = hashlib.sha256(), hashlib.sha256(), 0, 0, True

        def decoded(data: str) -> None:
            nonlocal at, same
            text_sha.update(data.encode())
            same = same and text.startswith(data, at)
            at += len(data)

        for pieces in self.split(text):
            if pieces:
                found = list(map(look, pieces))
                line = b" ".join([ids for ids, _ in found])
                ids_sha.update(b" " + line if n else line)
                n += line.count(b" ") + 1
                if kept is not None:
                    kept.append(np.fromstring(line, np.int32, sep=" "))
                decoded(machine.feed(b"".join([spelled for _, spelled in found])))
        decoded(machine.finish())
        return n, ids_sha.hexdigest(), text_sha.hexdigest(), same and at == len(text)

    def encode_parts(self, text: str):
        """Lists of ids; their concatenation is the text's encoding."""
        look = self.known.__getitem__
        for pieces in self.split(text):
            yield list(chain.from_iterable(map(look, pieces)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_parts(text)))

    def decode_parts(self, parts):
        """Texts of runs of ids, as characters become complete."""
        machine, spell = Utf8Machine(), self.spelled.__getitem__
        for ids in parts:
            yield machine.feed(b"".join(map(spell, ids)))
        if rest := machine.finish():
            yield rest

    def decode(self, ids) -> str:
        return "".join(self.decode_parts([ids]))


def _codec(source: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(source).hexdigest(), pattern)
    return keep("codec", key, lambda: Codec(source, pattern))


def _read(docs: DataFrame, ranks: str):
    with open(ranks, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode_texts(docs: DataFrame, ranks: str, pattern: str = PATTERN, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with an array<int> column of each whole text's ids (null text: empty array)."""
    source = _read(docs, ranks)
    schema = docs.drop(ids_col).select("*", F.lit(None).cast("array<int>").alias(ids_col)).schema

    def run(batches):
        codec = _codec(source.value, pattern)
        for batch in batches:
            ids = pa.array([codec.encode(t.as_py() or "") for t in column(batch, text_col)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, ids_col])

    return docs.drop(ids_col).mapInArrow(run, schema)


def decode_ids(docs: DataFrame, ranks: str, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """``docs`` with the text of an array<int> column (null array: null)."""
    source = _read(docs, ranks)
    schema = docs.drop(text_col).select("*", F.lit(None).cast("string").alias(text_col)).schema

    def run(batches):
        codec = _codec(source.value, PATTERN)
        for batch in batches:
            texts = pa.array([codec.decode(x.as_py()) if x.is_valid else None for x in column(batch, ids_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, text_col])

    return docs.drop(text_col).mapInArrow(run, schema)


def codec_digests(docs: DataFrame, ranks: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip[, token_ids]) for every row.

    Each whole text is encoded, its ids are decoded again, and both are
    digested part by part; a worker remembers the digits and the bytes of the
    ids of pieces that it has seen.  Null texts are empty.  Null ids and repeated rows
    pass through; a very long text is handled as a stream of parts.  No shuffle.
    Rows leave a few hundred at a time: neither side holds the ids of a whole batch.
    The rank file is read by the driver and broadcast (a fixed file under 1 MB).
    """
    source = _read(docs, ranks)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + (", token_ids array<int>" if ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        codec = _codec(source.value, pattern)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
        for batch in slices(batches):
            kept = [] if ids else None
            rows = [codec.digests(cell.as_py() or "", kept) for cell in column(batch, "text")]
            columns = list(map(pa.array, zip(*rows) if rows else ((),) * len(kinds), kinds))
            if ids:
                ends = np.cumsum([0, *(row[0] for row in rows)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *kept]))))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *columns], names=names)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, schema)
