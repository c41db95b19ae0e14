"""Byte-level BPE: a lazily determinised transducer encodes, an incremental UTF-8 automaton decodes.

A token sequence is the BPE encoding of its bytes exactly where each token, and each pair of neighbours, is one. So the
encoding of every prefix is known from those of shorter ones: its last token is the one that is compatible with the
encoding before it. The non-deterministic transducer guesses where tokens begin; determinised, its state is the set of
live guesses (trie node, last token before), and a move tells which token ends at its byte. A guess lives as long as some
token goes on, so the lookahead is bounded by the longest token: what all live guesses have behind them is emitted.
States and moves are made when first needed, from the merge ranks, and kept up to a bound in bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import beside, kept, quoted, read, unpacked

# The code points that Unicode calls white space.
WHITE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2000))) + "-" + "".join(map(chr, (0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Cuts a text where the pre-tokenizing pattern always cuts it: around white space, one space staying with what follows.
CHUNK = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Bytes that a worker keeps of encoded chunks, of moves and states, and of pairs of tokens, each about.
CHUNK_BYTES, MOVE_BYTES, FIT_BYTES = 96 << 20, 120 << 20, 24 << 20
#: What an entry of these costs besides its text and ids, about.
CHUNK_COST, MOVE_COST, STATE_COST, FIT_COST = 200, 80, 480, 110
#: Bytes of a piece after which what is settled is emitted.
SETTLE = 1 << 12


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Transducer:
    """Ids of one pre-token, four little-endian bytes each: a state and a byte give the next state and the token that ends
    there."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {v: k for k, v in ranks.items()}
        self.kids: dict[int, int] = {}  # node << 8 | byte: node
        self.token: list[int | None] = [None]
        self.depth, self.inner = [0], bytearray(1)
        for t, i in ranks.items():
            node = 0
            for c in t:
                self.inner[node] = 1
                if (to := self.kids.get(node << 8 | c)) is None:
                    to = self.kids[node << 8 | c] = len(self.token)
                    self.token.append(None)
                    self.depth.append(self.depth[node] + 1)
                    self.inner.append(0)
                node = to
            self.token[node] = i
        self.fits: dict = {}
        self.halves: dict = {}
        self._reset()

    def _reset(self) -> None:
        self.size, self.states = 0, {}
        self.start = self._state(((0, None),))

    def _state(self, guesses: tuple) -> dict:
        """A state's moves by byte: (next state, token). Its guesses, (trie node since the guess, last token before it) with
        the newest last, are kept at -1."""
        if (state := self.states.get(guesses)) is None:
            state = self.states[guesses] = {-1: guesses}
            self.size += STATE_COST
        return state

    def _parts(self, data: bytes) -> list[bytes]:
        """The merges done one by one, lowest rank first, until one is left to do at most."""
        get, never = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        order = [get(data[i : i + 2], never) for i in range(len(data) - 1)]
        while len(order) > 1 and (rank := min(order)) != never:
            at = order.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del order[at]
            if at:
                order[at - 1] = get(parts[at - 1] + parts[at], never)
            if at < len(order):
                order[at] = get(parts[at] + parts[at + 1], never)
        return parts

    def _halves(self, token: int) -> tuple | None:
        """The two tokens that a token is last merged from, () for a single byte, None for a token that merging its
        bytes doesn't give."""
        if token not in self.halves:
            parts = self._parts(self.bytes_of[token])
            known = tuple(self.ranks[p] for p in parts)
            if len(parts) == 2 and max(known) > token:
                raise ValueError(f"token {token} ranks before what it is merged from")
            self.halves[token] = () if len(parts) == 1 else known if len(parts) == 2 else None
        return self.halves[token]

    def _fit(self, before: int, token: int) -> bool:
        """Whether two tokens stay apart. Merges are undone from the last one on, and at every time the parts that meet
        must not be merged before either one's next merge; of equal ranks the left one comes first."""
        key = before << 32 | token
        if key in self.fits:
            return self.fits[key]
        if len(self.fits) * FIT_COST > FIT_BYTES:
            self.fits.clear()
        rank, data, never = self.ranks.get, self.bytes_of, 1 << 60
        left, right, left_next, right_next, ok = before, token, never, never, True
        while True:
            r = rank(data[left] + data[right], never)
            if r < left_next and r <= right_next and r != never:
                ok = False
                break
            a, b = self.halves[left], self.halves[right]
            if b and (right >= left or not a):
                right_next, right = right, b[0]
                if b[0] not in self.halves:
                    self._halves(b[0])
            elif a:
                left_next, left = left, a[1]
                if a[1] not in self.halves:
                    self._halves(a[1])
            else:
                break
        self.fits[key] = ok
        return ok

    def _move(self, state: dict, c: int) -> tuple[dict, int]:
        live, ending = [], None
        for node, last in state[-1]:
            if (to := self.kids.get(node << 8 | c)) is None:
                continue
            if self.inner[to]:
                live.append((to, last))
            if ending is None and (t := self.token[to]) is not None and self._halves(t) is not None and (last is None or self._fit(last, t)):
                ending = t
        move = state[c] = (self._state((*live, (0, ending))), ending)  # single bytes are tokens, so one always fits
        self.size += MOVE_COST
        return move

    def encode(self, piece: bytes) -> bytes:
        if (whole := self.ranks.get(piece)) is not None:
            return struct.pack("<I", whole)
        if self.size > MOVE_BYTES:
            self._reset()
        state, told, out, move = self.start, [], [], self._move
        for at in range(0, len(piece), SETTLE):
            for c in piece[at : at + SETTLE]:
                state, t = state.get(c) or move(state, c)
                told.append(t)
            if at + SETTLE < len(piece):
                done = self._settled(told, state)
                out += self._path(told, done)
                del told[:done]
        out += self._path(told, len(told))
        return struct.pack(f"<{len(out)}I", *out)

    def _path(self, told: list[int], end: int) -> list[int]:
        """The tokens before `end`, of which the last one ends there."""
        out = []
        while end:
            out.append(told[end - 1])
            end -= len(self.bytes_of[told[end - 1]])
        return out[::-1]

    def _settled(self, told: list[int], state: int) -> int:
        """The last token end that all live guesses have behind them."""
        starts, met = [len(told) - self.depth[node] for node, _ in state[-1]], None
        for at in starts:
            ends = {at}
            while at:
                at -= len(self.bytes_of[told[at - 1]])
                ends.add(at)
            met = ends if met is None else met & ends
        return max(met)


class Codec:
    """Texts to ids and back, by ranks and pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        inside = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.pieces, self.fst = regex.compile(inside), Transducer(self.ranks)
        #: Whether letters after a space, or none, are always one piece: so they are where this alternative is the pattern's.
        self.letters = r" ?\p{L}+" in pattern
        self.chunks, self.older, self.size = {}, {}, 0
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, i in self.ranks.items():
            self.tokens[i] = t
        self.decoder = Utf8(self.tokens)

    def _chunk(self, chunk: str) -> bytes:
        """One that is not among the newer chunks; when these are full, they become the older ones."""
        if (out := self.older.get(chunk)) is None:
            one = self.letters and chunk.removeprefix(" ").isalpha()
            pieces = (chunk,) if one else self.pieces.findall(chunk)
            out = b"".join([self.fst.encode(p.encode()) for p in pieces])
        if len(chunk) < 64:
            self.chunks[chunk] = out
            self.size += CHUNK_COST + len(chunk) + len(out)
            if 2 * self.size > CHUNK_BYTES:
                self.older, self.chunks, self.size = self.chunks, {}, 0
        return out

    def encode(self, text: str) -> bytes:
        """The ids, four little-endian bytes each."""
        chunks, out = CHUNK.findall(text), []
        for at in range(0, len(chunks), 1 << 12):
            known = self.chunks.get
            out += [known(c) or self._chunk(c) for c in chunks[at : at + (1 << 12)]]
        return b"".join(out)


class Utf8:
    """Incremental decoding: how many bytes of a character are still missing after each token."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        #: Tokens that begin and end between characters, whatever comes before.
        self.whole = np.array([self._open(t) == b"" and not (t[:1] and 0x80 <= t[0] < 0xC0) for t in tokens])

    @staticmethod
    def _open(data: bytes) -> bytes:
        """The unfinished character at the end."""
        for k in range(1, min(3, len(data)) + 1):
            c = data[-k]
            if c >= 0xC0:
                need = 2 if c < 0xE0 else 3 if c < 0xF0 else 4
                return data[-k:] if k < need else b""
            if c < 0x80:
                break
        return b""

    def stream(self, pieces):
        """Decoded bytes for each array of ids, cut between characters; what is unfinished at the end comes last as it is."""
        left = b""
        for ids in pieces:
            data = left + b"".join([self.tokens[i] for i in ids.tolist()])
            left = b"" if len(ids) and self.whole[ids[-1]] else self._open(data)
            yield data[: len(data) - len(left)]
        yield left


_held: dict = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _held:
        _held[path, pattern] = Codec(path, pattern)
    return _held[path, pattern]


RESULTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _encoded(docs: DataFrame, keep: tuple, text_col: str, path: str | None, pattern: str | None, with_ids: bool, piece: int) -> DataFrame:
    path, pattern = path or default_path(), pattern or default_pattern()

    def work(texts):
        c, rows, arrays = codec(path, pattern), [], []
        for t in texts:
            ids = c.encode(t or "")
            array, back = np.frombuffer(ids, "<u4"), hashlib.sha256()
            for part in c.decoder.stream(array[i : i + piece] for i in range(0, len(array), piece)):
                back.update(part)
            rows.append((len(array), hashlib.sha256(ids).hexdigest(), back.hexdigest()))
            arrays.append(array)
        out = [[r[i] for r in rows] for i in range(3)]
        if with_ids:
            ends = np.r_[0, np.cumsum([len(x) for x in arrays])].astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, "<u4")]).astype(np.int32))))
        return out

    return beside(docs.select(kept(keep), quoted(text_col)), RESULTS + ", ids array<int>" * with_ids, work, 1 << 20)


def encoded(docs: DataFrame, *, keep: tuple = ("doc_id",), text_col: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = False, piece: int = 1 << 14) -> DataFrame:
    """One row for every row of docs: the columns of `keep`, n_tokens, ids_sha256 and decoded_sha256 (ids as little-endian
    unsigned 32-bit integers; the bytes that decoding them piece by piece gives), and ids (array) if asked for.

    Works row by row without a shuffle, so repeated rows give a row each and ties don't arise. Null and empty texts have no
    ids; whole texts are encoded, however long. An empty table gives an empty result. Columns that aren't kept don't
    matter; a kept one that has a result's name comes back as kept_<name>.
    """
    found = _encoded(docs, keep, text_col, path, pattern, with_ids, piece)
    return unpacked(found, found.columns[1:])


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"))


def stage_bpe(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the digests and ids of every document, as a loader reads them; nulls, repeated rows and
    other columns as encoded() has it. An empty table gives an empty result."""
    return encoded(docs, keep=("doc_id", "lang", "source"), with_ids=True)
