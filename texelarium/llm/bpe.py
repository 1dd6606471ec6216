"""Byte-level BPE encoding and decoding by finite-state machines.

Encoding. For every prefix of a piece the encoding is unique, and a sequence of
tokens is the encoding exactly if every token encodes to itself and every two
neighbours do together. So the encoder is a nondeterministic transducer whose
configurations are (trie node of the token under way, last token before it). It
is determinised lazily: a deterministic state is the list of live
configurations, built when a text first needs it, and each step outputs the last
token of the encoding so far. A token is emitted as soon as the paths of all live
configurations agree on it, which takes a lookahead of about the longest token.
The last byte of a piece needs its token only, no state. Memory is bounded: states
and pieces are kept once they are met a second time, the state table is emptied at
its limit, and pieces are forgotten a turn after they were last met.

Decoding is streaming: an incremental UTF-8 state machine (malformed bytes
become U+FFFD) whose steps over whole tokens are remembered per (state, token).

Vocabulary files are parameters and are read, never copied: rank files hold one
"base64 rank" pair a line.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, light_batches, resident

#: White space of Unicode (the White_Space property), as a character class.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: The pattern that the faster one below equals; other patterns are applied as they are.
_KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Numerals that are no decimal digits: ``re`` takes them for letters.
_ODD = frozenset(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
#: The same pieces in the terms of ``re``, which is faster; it needs a text without numerals other than decimal digits.
_FAST = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\w{_SPACE}]|_)+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_STATES, _PIECES, _LONG, _MET = 100_000, 150_000, 256, (1 << 20) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Lazily determinised encoder of one piece (no splitting)."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = _STATES):
        self.ranks, self.most = ranks, most_states
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size = {i: (i, len(b)) for b, i in ranks.items()}
        missing = sum(bytes([b]) not in ranks for b in range(256))
        if missing:
            raise ValueError(f"a byte-level vocabulary needs all single bytes; {missing} are missing")
        # trie: node << 8 | byte to node; token and depth of a node, and whether it goes on
        self.child: dict[int, int] = {}
        self.token, self.depth, self.inner = [-1], [0], [True]
        for b, i in ranks.items():
            node = 0
            for c in b:
                self.inner[node] = True
                to = self.child.get(node << 8 | c)
                if to is None:
                    to = self.child[node << 8 | c] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.inner.append(False)
                node = to
            self.token[node] = i
        self.bits = max(self.bytes_of).bit_length()
        self.pairs: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        """Forgets all states.

        A state is a table from byte to next state; None holds its configurations,
        whose last number is the last token so far. States may lead back to
        themselves, so their memory is collected here, not some time later.
        """
        old = hasattr(self, "known")
        self.start: dict = {None: (0, -1)}
        self.known: dict[tuple, dict] = {(0, -1): self.start}
        self.met = bytearray(_MET + 1)  # hashes of the states met so far; a state is kept when met again
        if old:
            gc.collect()

    def state(self, configurations: tuple) -> dict:
        found = self.known.get(configurations)
        if found is None:
            found = self.known[configurations] = {None: configurations}
        return found

    def merge(self, piece: bytes, until: int = 1) -> list[bytes]:
        """Plain definition, for short byte strings: merge the lowest-ranked pair until none or ``until`` parts are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes t last; (-1, -1) for a byte; None if t does not encode to itself."""
        if t not in self.parts:
            b = self.bytes_of[t]
            if len(b) == 1:
                self.parts[t] = -1, -1
            else:
                two = self.merge(b, 2)
                self.parts[t] = (self.ranks[two[0]], self.ranks[two[1]]) if len(two) == 2 else None
        return self.parts[t]

    def fits(self, s: int, t: int) -> bool:
        """Does t encode to itself, and do tokens s (-1: none) and t side by side, where s does?

        Merges run in the order of rank, so undoing them from the last one back
        visits every two parts that ever stand side by side at the bound. The
        tokens stay apart if no such pair would merge while both are there. (A
        part that ranks above what it makes breaks that order: then by definition.)
        """
        key = s << self.bits | t
        ok = self.pairs.get(key)
        if ok is not None:
            return ok
        if len(self.pairs) > 300_000:
            self.pairs.clear()
        ranks, name = self.ranks, self.bytes_of
        a, b, end_a, end_b = s, t, 1 << 60, 1 << 60
        ok = self.split(t) is not None
        while ok and s >= 0:
            r = ranks.get(name[a] + name[b])
            if r is not None and r < end_a and r <= end_b:
                ok = False
                break
            pa, pb = self.split(a), self.split(b)
            byte_a, byte_b = pa[0] < 0, pb[0] < 0
            if byte_a and byte_b:
                break
            if byte_b or not byte_a and a > b:  # the later merge is undone; of equal ones, the right one
                if pa[1] > a or pa[0] > a:
                    ok = self.merge(name[s] + name[t]) == [name[s], name[t]]
                    break
                a, end_a = pa[1], a
            else:
                if pb[0] > b or pb[1] > b:
                    ok = self.merge(name[s] + name[t]) == [name[s], name[t]]
                    break
                b, end_b = pb[0], b
        self.pairs[key] = ok
        return ok

    def step(self, state: dict, c: int) -> dict:
        """Builds one deterministic transition: the next state."""
        live, done = [], -1
        child, token, inner, pairs, bits = self.child, self.token, self.inner, self.pairs, self.bits
        both = iter(state[None])
        for node, s in zip(both, both):
            to = child.get(node << 8 | c)
            if to is None:
                continue
            if done < 0 and (t := token[to]) >= 0:
                ok = pairs.get(s << bits | t)
                if self.fits(s, t) if ok is None else ok:
                    done = t
            if inner[to]:
                live.append(to)
                live.append(s)
        live.append(0)
        live.append(done)
        name = tuple(live)
        got = self.known.get(name)
        if got is None:
            at = hash(name) & _MET
            if not self.met[at]:  # most states are met once only, in one rare piece, and are not kept
                self.met[at] = 1
                return {None: name}
            got = self.known[name] = {None: name}
        state[c] = got
        return got

    def stream(self, chunks: Iterable[bytes], every: int = 256) -> Iterator[int]:
        """Encodes a piece that arrives in chunks, emitting tokens after bounded lookahead."""
        state, last = self.start, []
        for chunk in chunks:
            for c in chunk:
                got = state.get(c)
                if got is None:
                    if len(self.known) >= self.most:
                        self.reset()
                        state = self.state(state[None])
                    got = self.step(state, c)
                state = got
                last.append(state)
                if len(last) >= every:
                    n = self._agreed(last, state)
                    yield from self._path(last, n)
                    del last[:n]
        yield from self._path(last, len(last))

    def end(self, state: dict, c: int) -> int:
        """The last token where a piece ends with c: what ``step`` would find, without the state behind it."""
        child, token, pairs, bits = self.child, self.token, self.pairs, self.bits
        both = iter(state[None])
        for node, s in zip(both, both):
            to = child.get(node << 8 | c)
            if to is not None and (t := token[to]) >= 0:
                ok = pairs.get(s << bits | t)
                if self.fits(s, t) if ok is None else ok:
                    return t
        raise AssertionError("every byte string has an encoding")

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) > 256:
            return tuple(self.stream((piece,)))
        if len(self.known) >= self.most:
            self.reset()
        state, last = self.start, []
        add = last.append
        for c in piece[:-1]:
            got = state.get(c)
            state = self.step(state, c) if got is None else got
            add(state)
        c = piece[-1]
        got = state.get(c)
        t, n = self.size[self.end(state, c) if got is None else got[None][-1]]
        return *self._path(last, len(piece) - n), t

    def _path(self, last: list[dict], end: int) -> list[int]:
        """The tokens up to a bound, read backwards from the last token there; ``last`` has the state after each byte."""
        out, size = [], self.size
        while end > 0:
            t, n = size[last[end - 1][None][-1]]  # one object per token, so that memos stay small
            out.append(t)
            end -= n
        out.reverse()
        return out

    def _agreed(self, last: list[dict], state: dict) -> int:
        """The furthest bound that the paths of all live configurations have in common."""
        starts = {len(last) - self.depth[n] for n in state[None][::2]}
        while len(starts) > 1:
            k = max(starts)
            starts.discard(k)
            starts.add(k - self.size[last[k - 1][None][-1]][1])
        return max(0, starts.pop())


class Utf8:
    """Incremental UTF-8 decoder: feed bytes, get text; malformed sequences become U+FFFD.

    The state is the bytes of the sequence under way, so there are few states:
    a lead byte bounds what may follow (no surrogates, no overlong forms, up to U+10FFFF).
    """

    @staticmethod
    def need(lead: int) -> int:
        return 0 if lead < 0x80 else 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else -1

    @staticmethod
    def follows(held: bytes, c: int) -> bool:
        if len(held) > 1:
            return 0x80 <= c <= 0xBF
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(held[0], 0x80)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(held[0], 0xBF)
        return low <= c <= high

    @classmethod
    def feed(cls, held: bytes, data: bytes) -> tuple[bytes, str]:
        out: list[str] = []
        for c in data:
            if held:
                if cls.follows(held, c):
                    held += bytes([c])
                    if len(held) == cls.need(held[0]) + 1:
                        out.append(held.decode("utf-8"))
                        held = b""
                    continue
                out.append("�")
                held = b""
            n = cls.need(c)
            if n == 0:
                out.append(chr(c))
            elif n < 0:
                out.append("�")
            else:
                held = bytes([c])
        return held, "".join(out)


class Codec:
    """Splits, encodes and decodes whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.fine = regex.compile(pattern)
        self.known = pattern == _KNOWN
        #: pieces to ids: those met again since the last turn, and those of the turn before
        self.memo: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.met = bytearray(_MET + 1)  # hashes of the pieces met in this turn
        self.name = {i: str(i) for i in self.machine.bytes_of}
        #: UTF-8 state to {token: (next state's table, text)}
        self.heard: dict[bytes, dict] = {b"": {}}

    def _piece(self, piece: str) -> tuple:
        """Ids of a piece that is not kept since the last turn."""
        ids = self.older.get(piece)
        if ids is None:
            ids = self.machine.encode(piece.encode("utf-8", "replace"))
            if len(piece) > _LONG:
                return ids
            at = hash(piece) & _MET
            if not self.met[at]:  # many pieces are met once only and are not kept
                self.met[at] = 1
                return ids
        if len(self.memo) >= _PIECES:
            self.older, self.memo, self.met = self.memo, {}, bytearray(_MET + 1)
        self.memo[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        get, piece = self.memo.get, self._piece
        pieces = _FAST if self.known and _ODD.isdisjoint(text) else self.fine
        return [t for m in pieces.findall(text) for t in get(m) or piece(m)]

    def _hear(self, table: dict, t: int) -> tuple:
        held = next(k for k, v in self.heard.items() if v is table)
        to, text = Utf8.feed(held, self.machine.bytes_of[t])
        got = table[t] = self.heard.setdefault(to, {}), text
        return got

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Streams the text of a token sequence."""
        start = table = self.heard[b""]
        for t in ids:
            table, text = table.get(t) or self._hear(table, t)
            yield text
        if table is not start:
            yield "�"


def codec(path: str, pattern: str) -> Codec:
    """One codec a Python worker; its tables are kept between tasks."""
    return resident(("bpe", path, pattern), lambda: Codec(load_ranks(path), pattern))


def _run(path: str, pattern: str, with_ids: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            ids_out, n, digest, back, size = [], [], [], [], []
            for text in (t.as_py() for t in batch.column("text")):
                ids = c.encode(text or "")
                decoded = "".join(c.decode(ids)).encode("utf-8")
                n.append(len(ids))
                digest.append(hashlib.sha256(",".join(map(c.name.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(decoded).hexdigest())
                size.append(len(decoded))
                if with_ids:
                    ids_out.append(ids)
            ids_col = {"ids": pa.array(ids_out, pa.list_(pa.int32()))} if with_ids else {}
            cols = {"id": batch.column("id"), **ids_col, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(digest, pa.string()), "decoded_bytes": pa.array(size, pa.int64()), "decoded_sha256": pa.array(back, pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, ids, n_tokens, ids_sha256, decoded_bytes, decoded_sha256), one row per row of ``docs``.

    ``path`` must name a vocabulary file that every executor has (installed with
    the tokenizer package). Null text is the empty text: no tokens. Repeated rows
    and ids are encoded as they come; other columns are ignored. Without
    ``with_ids`` the ids column is left out. The work is a map: no shuffle.
    """
    light_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    rest = "n_tokens long, ids_sha256 string, decoded_bytes long, decoded_sha256 string"
    ids = "ids array<int>, " if with_ids else ""
    return src.mapInArrow(_run(path, pattern, with_ids), f"id {kind}, {ids}{rest}")


def _decode(path: str, pattern: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            texts = ["".join(c.decode(x.as_py())) if x.is_valid else None for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def decode_documents(tokens: DataFrame, path: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of token sequences; null ids give null text."""
    src = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return src.mapInArrow(_decode(path, pattern), f"id {src.schema['id'].dataType.simpleString()}, text string")
