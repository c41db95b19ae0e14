"""Token ids of whole texts through a cache of words, for vocabularies that never join across white space."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from .common import _table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: A-Z to lower case, line breaks to spaces; everything else stays.
LOWER = bytes(32 if c == 10 else _table([])[c] for c in range(256))
TAIL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)  # ASCII punctuation but for the apostrophe
#: Kinds of bytes in a word: a to z, punctuation of TAIL, beyond ASCII, others; 0 for the space.
KIND = np.array([0 if c == 32 else 1 if 97 <= c <= 122 else 2 if c in TAIL else 4 if c > 127 else 8 for c in range(256)], np.uint8)
LIMIT = 700_000
#: Letters of what lies below are the same to Python and to the library, whatever their versions of Unicode.
KNOWN_LETTERS = "\u0530"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges:
    """Byte-pair merges of many words at once, for a byte-level vocabulary with word ends: in each round every word merges
    its pair of the least rank, as it would alone."""

    NONE = np.int32(np.iinfo(np.int32).max)

    def __init__(self, path: str, library):
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = dict(zip(shown, map(chr, shown), strict=True)) | {c: chr(256 + n) for n, c in enumerate(sorted({*range(256)} - {*shown}))}
        ids, (self.size, self.bytes) = library.get_vocab(), (library.get_vocab_size(), np.zeros((2, 256), np.int64))
        for c, sign in shown.items():
            self.bytes[:, c] = ids[sign], ids[sign + "</w>"]
        with open(path, encoding="utf-8") as f:
            pairs = [m.split(" ") if isinstance(m, str) else m for m in json.load(f)["model"]["merges"]]
        key = np.array([ids[a] * self.size + ids[b] for a, b in pairs])
        self.rank = np.argsort(key).astype(np.int32)
        self.key, self.made = key[self.rank], np.array([ids[a + b] for a, b in pairs])
        self.first = self.ranks(self.bytes[0][:, None], self.bytes.reshape(1, -1))  # of two bytes, the second within or at the end

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each pair's rank, NONE where it never merges."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], self.NONE)

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words with single spaces between them, and where each word's begin, with the end."""
        data = np.frombuffer(text + b" ", np.uint8)
        last = np.flatnonzero(data == 32) - 1
        end = np.zeros(len(data), np.int64)
        end[last] = 1
        some = data != 32
        word = np.repeat(np.arange(len(last)), np.diff(np.r_[-2, last]) - 1)
        code = (data + 256 * end)[some]
        ids, rank, done = self.bytes.ravel()[code], np.full(len(code), self.NONE), []
        inner = np.flatnonzero(code < 256)
        rank[inner] = self.first[code[inner], code[inner + 1]]
        while len(ids):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(ids)]))
            open_ = least != self.NONE
            if not open_.all():
                done.append((word[~open_], ids[~open_]))
                word, ids, rank, least = word[open_], ids[open_], rank[open_], least[open_]
            hit = rank == least
            hit[1:] &= ~hit[:-1]  # of pairs that overlap the first; the next round finds the others
            at = np.flatnonzero(hit)
            ids[at] = self.made[rank[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            word, ids, rank = word[stay], ids[stay], rank[stay]
            at -= np.arange(len(at))
            new = np.concatenate([at, at[at > 0] - 1])
            rank[new] = self.NONE
            new = new[new + 1 < len(ids)]
            new = new[word[new] == word[new + 1]]
            rank[new] = self.ranks(ids[new], ids[new + 1])
        word, ids = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        order = np.argsort(word, kind="stable")
        return ids[order], np.searchsorted(word[order], np.arange(len(last) + 1))


class WordIds:
    """Little-endian unsigned ids of texts as tokenizers.Tokenizer.encode(text, add_special_tokens=False) gives them.

    Right where the tokenizer lower-cases, turns white space into single spaces and drops these, as the word-end
    vocabulary does: then its ids of a text are those of its space-separated words, one after another. New words are
    encoded together by the library (with merges: those of Latin, Greek or Cyrillic letters by Merges); a word with punctuation at its end is cut there if it is made of letters before.
    Words of a to z are in normal form and whole as they are, so the library gives them to its model without looking, and
    without a cache, which new words never meet.
    Where no dtype is given, ids take 16 bits, or 32 if the vocabulary needs them.
    """

    def __init__(self, path: str, dtype: type | None = np.uint16, limit: int = LIMIT, merges: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        dtype = dtype or (np.uint16 if self.library.get_vocab_size() <= np.iinfo(np.uint16).max else np.uint32)
        self.dtype, self.limit, self.known = np.dtype(dtype).newbyteorder("<"), limit, {b"": b""}
        if self.library.get_vocab_size() > np.iinfo(self.dtype).max:
            raise ValueError(f"{path} has too many ids for {self.dtype}")
        #: Ids that end a word.
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.merges = Merges(path, self.library) if merges else None
        self.plain = self.library if merges else self._plain(path)

    def _plain(self, path: str):
        """The library's tokenizer for words of a to z with single spaces between them; the whole one for other models."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model.get("type") != "BPE":
            return self.library
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        more = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        out = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **{k: model[k] for k in more if model.get(k) is not None}))
        out.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        return out

    def _learn(self, words: list[bytes]) -> None:
        known, raw = self.known, np.frombuffer(b" ".join(words) + b" ", np.uint8)
        kind, stop = KIND[raw], np.flatnonzero(raw == 32)
        start = np.r_[0, stop[:-1] + 1]
        has, tail = np.bitwise_or.reduceat(kind, start), kind == 2
        cut = np.minimum.reduceat(np.where(tail, np.arange(len(raw)), len(raw)), start)  # where a word's first punctuation is
        ends = (has & 8 == 0) & (has & 2 > 0) & (has & 5 > 0) & (cut + np.add.reduceat(tail, start, dtype=np.int64) == stop)
        plain, high = (list(map(words.__getitem__, np.flatnonzero(x).tolist())) for x in (has == 1, (has & 4 > 0) & (has & 10 == 0)))
        new = list(map(words.__getitem__, np.flatnonzero((has != 1) & ~ends & ((has & 4 == 0) | (has & 10 > 0))).tolist()))
        wide, halves, own = [], [], set(words)
        for w, letters in zip(high, map(str.isalpha, b" ".join(high).decode().split(" ")), strict=True) if high else ():
            (wide if letters else new).append(w)
        for x, n in zip(np.flatnonzero(ends).tolist(), (cut - start)[ends].tolist(), strict=True):
            w = words[x]
            head = w[:n]
            if head.isascii() or head.decode().isalpha():
                halves.append((w, head, w[n:]))
            else:
                new.append(w)
        heads, tails = ([w for w in {h[x] for h in halves} if w not in known and w not in own] for x in (1, 2))
        new += tails
        plain += [w for w in heads if w.isascii()]
        wide += [w for w in heads if not w.isascii()]
        if self.merges:
            some = [w for w in wide if max(w.decode()) < KNOWN_LETTERS]
            rest = set(wide).difference(some)
            for part in (x[at : at + 10_000] for x in (plain, some) for at in range(0, len(x), 10_000)):
                if not self._merged(part):
                    rest.update(part)
            plain, wide = [], list(rest)
        for order, library in ((plain, self.plain), (wide, self.library)):
            for at in range(0, len(order), 1000):
                if not self._together(part := order[at : at + 1000], library):
                    new += part
        for w, got in zip(new, self.library.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
            known[w] = np.asarray(got.ids, self.dtype).tobytes()
        for w, head, tail in halves:
            known[w] = known[head] + known[tail]

    def _merged(self, words: list[bytes]) -> bool:
        """Learns words of letters by merges; none, and False, if their normal form is not of as many words of letters."""
        text = b" ".join(words)
        if text.isascii():
            text = text.lower()
        else:
            text = self.library.normalizer.normalize_str(text.decode())
            parts = text.split(" ")
            if len(parts) != len(words) or not all(map(str.isalpha, parts)):
                return False
            text = text.encode()
        ids, cuts = self.merges.encode(text)
        data, cuts = ids.astype(self.dtype).tobytes(), (cuts * self.dtype.itemsize).tolist()
        self.known.update(zip(words, map(data.__getitem__, map(slice, cuts[:-1], cuts[1:])), strict=True))
        return True

    def _together(self, words: list[bytes], library) -> bool:
        """Learns words of letters as one text, which is cut after each id that ends a word; none, and False, if some word
        has more than one such id."""
        ids = np.asarray(library.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.int64)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or cuts[-1] != len(ids):
            return False
        data, cuts = ids.astype(self.dtype).tobytes(), (cuts * self.dtype.itemsize).tolist()
        self.known.update(zip(words, map(data.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
        return True

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as bytes."""
        ids, lengths = self.ended(texts)
        ends = np.cumsum(lengths)
        return [ids[a:z].tobytes() for a, z in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]

    def ended(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after another, each with the id `end` behind it (None: nothing), and how many
        each has. Words are numbered by Arrow, and only different ones are looked up."""
        if not texts:
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        data = b" \n ".join([*(t.translate(LOWER) for t in texts), b""])  # a line break, which no word has, is each text's end
        cuts = np.r_[0, np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1]  # each word goes with the space behind it
        coded = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        words, code = coded.dictionary.buffers()[2].to_pybytes().split(b" ")[: len(coded.dictionary)], coded.indices.to_numpy()
        mark = words.index(b"\n")
        words[mark] = b""
        self._know(set(words))
        ids = list(map(self.known.__getitem__, words))
        ids[mark] = b"" if end is None else np.array([end], self.dtype).tobytes()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        flat, skip, many = np.frombuffer(b"".join(ids), self.dtype), np.cumsum(size) - size, size[code]
        upto = np.cumsum(many)
        at = np.repeat(skip[code] - (upto - many), many)
        at += np.arange(len(at))
        return flat[at], np.diff(upto[code == mark], prepend=0)

    def each(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words that are split at white space and lower-cased (A-Z) already."""
        self._know(set(words))
        return list(map(self.known.__getitem__, words))

    def _know(self, words: set) -> None:
        if len(self.known) > self.limit:
            self.known = {b"": b""}
        new = list(words.difference(self.known))
        for at in range(0, len(new), 50_000):
            self._learn(new[at : at + 50_000])


_held: dict = {}


def word_ids(path: str, dtype: type | None = np.uint16, merges: bool = False) -> WordIds:
    """One for each Python worker, which its next tasks use again."""
    key = (path, dtype, merges)
    if key not in _held:
        _held[key] = WordIds(path, dtype, merges=merges)
    return _held[key]


def groups(texts: list, most: int = 1 << 20):
    """Ranges of texts of about `most` bytes together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
