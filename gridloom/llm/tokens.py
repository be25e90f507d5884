"""Encoding of whole texts on executors with files of the ``tokenizers`` library."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed value: the split pattern of a tokenizer that drops white space and never looks across it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Punctuation that both splitting rules keep apart from the letters and numbers before it.
CLOSING = ".,;:!?&%#*$|)]}"
#: Punctuation is cut from letters and numbers of the scripts before this code point, which no version
#: of Unicode sees otherwise and whose normal forms end in a letter or number, but for one letter:
#: I with a dot becomes two code points in small letters, the second of them a mark.
CUT_BEFORE, DOTTED_I = "\u0530", "\u0130"
#: A line break between two words: its key as a piece, and white space that would join it.
LINE, DOUBLE_SPACE = "\0\n", re.compile(r"\s\s")
COMBINING = "[\u0300-\u036f]"


def tokenizer_path(name: str) -> str:
    """``name`` is a path, or the name of a file of the installed vocabulary package."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(name: str):
    """The tokenizer and its parsed file; kept for the life of a Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    path = tokenizer_path(name)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return Tokenizer.from_file(path), spec


def _split_mode(spec: dict) -> str:
    """How a text may be cut at single spaces without changing its ids.

    ``prefix``: byte-level splitting in which a word takes the space before it.  A space after a
    non-white character always starts a new word, and what a word becomes depends on nothing
    before it.  ``drop``: white space is dropped and no word spans it.  ``whole``: unknown rules,
    texts are encoded in one go.
    """
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "prefix"
    kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    first = (pre.get("pretokenizers") or [{}])[0]
    if kinds == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": WORD_PATTERN}:
        return "drop"
    return "whole"


class _Joined:
    """Pieces made of others: their numbers, and the numbers of their parts one after the other."""

    def __init__(self):
        self.numbers, self.parts, self.counts = [], [], []

    def add(self, number: int, parts) -> None:
        self.numbers.append(number)
        self.parts.extend(parts)
        self.counts.append(len(parts))


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Texts are cut at single spaces where the tokenizer's own rules make the pieces independent;
    every distinct piece is encoded once by the library and remembered.  Texts in which a cut
    would not be safe (white space before a space, special strings) are encoded in one go.
    When the memory holds ``limit`` pieces, those not seen again lately are dropped; that costs
    time, never results.
    """

    def __init__(self, name: str, limit: int = 700_000, longest: int = 256):
        self.tokenizer, spec = load(name)
        self.mode = _split_mode(spec)
        added = spec.get("added_tokens") or []
        self.special, self.special_ids = [t["content"] for t in added], [t["id"] for t in added]
        # Bytes of text that each token stands for; a byte-level token has a character per byte.
        suffix = (spec.get("model") or {}).get("end_of_word_suffix") or ""
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.sizes[i] = len(token.removesuffix(suffix) if suffix else token)
        self.limit, self.longest = limit, longest
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype="<u4"), 0
        self.starts, self.lengths = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.again = np.zeros(1, dtype=bool)

    def _compact(self) -> None:
        """Keep the pieces that were met again since the last time."""
        stay = np.flatnonzero(self.again)
        if len(stay) > 0.75 * self.limit:
            return self._forget()
        keys, flat, starts, lengths = list(self.known), self.flat, self.starts[stay], self.lengths[stay]
        self._forget()
        for i in stay.tolist():
            self.known[keys[i - 1]] = len(self.known) + 1
        self._append(_ranges(flat, starts, lengths), lengths)

    def _append(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Add ids of new pieces."""
        starts = self._store(ids, lengths)
        self.starts, self.lengths = np.concatenate((self.starts, starts)), np.concatenate((self.lengths, lengths))
        self.again = np.concatenate((self.again, np.zeros(len(lengths), dtype=bool)))

    def _store(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Where the ids of each piece lie from now on."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), dtype="<u4")))
        self.flat[self.used : self.used + len(ids)] = ids
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        return starts

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raws = self._library(pieces)
        return np.frombuffer(b"".join(raws), dtype="<u4"), np.array([len(r) // 4 for r in raws], dtype=np.int64)

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces from few calls over the running text, cut by the bytes that tokens stand for."""
        found = [(np.zeros(0, "<u4"), np.zeros(0, np.int64))]
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            if self.mode == "prefix":
                joined, sizes = "".join(part), [len(p) if p.isascii() else len(p.encode()) for p in part]
            else:
                joined = " ".join(part)
                sizes = self._plain_sizes(part)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            reached = np.concatenate(([0], np.cumsum(self.sizes[ids])))
            wanted = np.concatenate(([0], np.cumsum(sizes)))
            cuts = np.searchsorted(reached, wanted)
            if cuts[-1] == len(ids) and np.array_equal(reached[cuts], wanted):
                found.append((ids, np.diff(cuts)))
            else:
                found.append(self._one_by_one(part))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Number of each piece, given on first sight; 0 for one that must not stand alone.

        Words with punctuation behind them are put together from the two, and words around a line
        break from those before and after it.
        """
        known, special, longest, marked = self.known, self.special, self.longest, self.mode == "prefix"
        get, mark, n = known.get, "\0" if marked else "", len(known)
        out = np.fromiter(map(get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        missing = np.flatnonzero(out < 0).tolist()
        fresh, fresh_numbers, given = [], [], []
        closed, broken = _Joined(), _Joined()

        number_of, learn, learnt = known.setdefault, fresh.append, fresh_numbers.append

        def simple(piece: str) -> int:
            nonlocal n
            number = number_of(piece, n + 1)
            if number > n:
                n = number
                learn(piece)
                learnt(n)
            return number

        def word(piece: str) -> int:
            nonlocal n
            stem = piece.rstrip(CLOSING)
            last = stem[-1:]
            if len(stem) == len(piece) or not last.isalnum() or last >= CUT_BEFORE or last == DOTTED_I:
                return simple(piece)
            number = get(piece)
            if number is None:
                ends = simple(stem), simple(mark + piece[len(stem) :])
                number = known[piece] = n = n + 1
                closed.add(n, ends)
            return number

        for j in missing:
            piece = pieces[j]
            if len(piece) > longest or "<" in piece and any(s in piece for s in special) or marked and (piece == "" or piece == "\0" or piece[-1].isspace()):
                given.append(0)
            elif piece[-1:] not in CLOSING and (not marked or "\n" not in piece):
                # As simple(), in place: most pieces come here.
                number = number_of(piece, n + 1)
                if number > n:
                    n = number
                    learn(piece)
                    learnt(n)
                given.append(number)
            elif marked and "\n" in piece and not DOUBLE_SPACE.search(piece) and piece.removeprefix("\0")[0] != "\n":
                before, *rest = piece.split("\n")
                parts = [word(before)]
                for part in rest:
                    parts += simple(LINE), word("\0" + part)
                number = get(piece)
                if number is None:
                    number = known[piece] = n = n + 1
                    broken.add(n, parts)
                given.append(number)
            else:
                given.append(word(piece))
        out[missing] = given
        if n >= len(self.starts):
            more = n + 1 - len(self.starts)
            self.starts, self.lengths = (np.concatenate((x, np.zeros(more, np.int64))) for x in (self.starts, self.lengths))
            self.again = np.concatenate((self.again, np.zeros(more, dtype=bool)))
            self._learn(fresh, np.array(fresh_numbers, dtype=np.int64))
            for joined in (closed, broken):  # the second is made of the first
                parts, counts = np.array(joined.parts, dtype=np.int64), np.array(joined.counts, dtype=np.int64)
                ids = _ranges(self.flat, self.starts[parts], self.lengths[parts])
                sizes = np.add.reduceat(self.lengths[parts], np.cumsum(counts) - counts) if len(counts) else counts
                self.starts[joined.numbers], self.lengths[joined.numbers] = self._store(ids, sizes), sizes
        return out

    def _learn(self, fresh: list[str], numbers: np.ndarray) -> None:
        """Ids of new pieces."""
        if self.mode == "prefix":
            first = np.array([p[0] == "\0" for p in fresh], dtype=bool)
            inner = self._together([" " + p for p in fresh if p[0] != "\0"])
            parts = [(numbers[~first], inner), (numbers[first], self._one_by_one([p[1:] for p in fresh if p[0] == "\0"]))]
        else:
            parts = [(numbers, self._together(fresh))]
        for at, (ids, sizes) in parts:
            self.starts[at], self.lengths[at] = self._store(ids, sizes), sizes

    def _plain_sizes(self, pieces: list[str]) -> list[int]:
        """Bytes of the pieces as the normalizer leaves them, white space dropped."""
        sizes = [len(p) for p in pieces]
        odd = [i for i, p in enumerate(pieces) if not (p.isascii() and p.isprintable())]
        normal = self.tokenizer.normalizer.normalize_str("\1".join(pieces[i] for i in odd)).split("\1")
        if len(normal) != len(odd):
            normal = [self.tokenizer.normalizer.normalize_str(pieces[i]) for i in odd]
        for i, text in zip(odd, normal, strict=True):
            sizes[i] = len("".join(text.split()).encode())
        return sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.mode == "whole" or not texts:
            return self._library(texts)
        if len(self.known) > self.limit or self.used > 8 * self.limit:
            self._compact()
        marked, nul = self.mode == "prefix", []
        cut = pa.array(texts, pa.large_string())
        if marked:  # NUL marks a first piece, so texts that hold one themselves are encoded in one go
            odd = pc.match_substring(cut, "\0")
            nul = np.flatnonzero(np.asarray(odd)).tolist()
            cut = pc.if_else(odd, "", cut) if nul else cut
        else:
            # White space is dropped and A-Z are lower-cased anyway; to do so first makes fewer distinct
            # pieces.  What a mark composes to may depend on the case of its letter, so such texts wait.
            small = pc.replace_substring(pc.ascii_lower(cut), "\n", " ")
            cut = pc.if_else(pc.match_substring_regex(cut, COMBINING), cut, small)
        listed = pc.split_pattern(cut, " ")
        told = listed.flatten().dictionary_encode()
        place, distinct = np.asarray(told.indices), told.dictionary.to_pylist()
        counts = np.asarray(pc.list_value_length(listed), dtype=np.int64)
        before = len(self.known)
        number = self._numbers(distinct)[place]
        ends = np.cumsum(counts)
        if marked:  # the first piece has no space before it
            at = ends - counts
            number[at] = self._numbers(["\0" + distinct[j] for j in place[at].tolist()])
        self.again[number[number <= before]] = True
        lengths = self.lengths[number]
        ids = _ranges(self.flat, self.starts[number], lengths).tobytes()
        total = np.concatenate(([0], np.cumsum(lengths)))
        bounds = 4 * total[np.concatenate(([0], ends))]
        out = [ids[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
        unsafe = [*nul, *np.unique(np.searchsorted(ends, np.flatnonzero(number == 0), side="right")).tolist()]
        for i, whole in zip(unsafe, self._library([texts[i] for i in unsafe]), strict=True):
            out[i] = whole
        return out


def _ranges(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges [start, start + length) of ``flat``, one after the other."""
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(lengths.sum())]


@lru_cache(maxsize=4)
def piece_encoder(name: str) -> PieceEncoder:
    return PieceEncoder(name)


def give_back() -> None:
    """Free what encoders of this worker remember, for work that encodes nothing; they are made again when asked for."""
    piece_encoder.cache_clear()
    load.cache_clear()
