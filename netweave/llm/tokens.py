"""Token ids of a byte-level BPE vocabulary, as numpy arrays."""

from __future__ import annotations

import json
import re
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa

from netweave.llm.words import mix, running_hash, text_chunks, tidy

#: Fixed value: the pattern that splits text before the merges, as published with this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Scripts for which both tokenizer libraries agree on what letters and digits are.
_OTHER = re.compile("[^\u0000-ɏ‐-‧₠-₿]")
#: No token runs from a character that is not blank into a blank, so texts may be cut there.
_CUT = re.compile(r"(?<=[^\s])(?= )")
_CUT_CHARS = 1 << 18


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: printable Latin-1 stands for itself, the rest from 256 on."""
    out, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(256 + n)] = b
            n += 1
    return out


#: Bytes of text whose pieces are looked up together, and pieces that a process remembers.
_CHUNK, _REMEMBERED = 1 << 20, 200_000

# byte classes of the fast path: letters, digits, blanks, anything else; bytes from 0x80 on are letters there
_LETTER, _NUMBER, _BLANK, _OTHER_CLASS = 0, 1, 2, 3
_KIND = np.full(256, _OTHER_CLASS, np.uint8)
_KIND[128:] = _LETTER
for _b in range(128):
    if chr(_b).isalpha():
        _KIND[_b] = _LETTER
    elif chr(_b).isdigit():
        _KIND[_b] = _NUMBER
    elif _b in (9, 10, 11, 12, 13, 32):
        _KIND[_b] = _BLANK
#: Bytes that only the libraries judge: the apostrophe (contractions), "|" (special tokens), and beyond U+00C0..U+023F.
_ODD = np.zeros(256, bool)
_ODD[[0x27, 0x7C]] = True
_ODD[0xC0:0xC3] = _ODD[0xC9:] = True


def _odd_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that the fast path leaves to the libraries."""
    odd = _ODD[data]
    if len(data) > 1:  # the two signs among the Latin-1 letters
        odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    total = np.concatenate([[0], np.cumsum(odd)])
    return total[offsets[1:]] > total[offsets[:-1]]


def _piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of ``PATTERN`` begin, for texts without contractions.

    Letters, digits and other signs run on, with one space in front; of several blanks before a sign the last stands
    apart, and joins the sign if it is a space; blanks at the end of a text stay together.
    """
    kind = _KIND[data]
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[0] = after[-1] = _BLANK
    space = np.zeros(len(data), bool)
    space[1:] = data[:-1] == 32
    blank = kind == _BLANK
    starts = ~blank & (kind != before) & ~space
    starts |= blank & ((before != _BLANK) | (after != _BLANK))
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    # a blank that ends a text has no sign behind it, whatever the next text begins with
    starts[ends[blank[ends] & (before[ends] == _BLANK)]] = False
    # what begins a text begins a piece, and what follows it is judged as after a text's own first byte
    starts[filled] = True
    return np.flatnonzero(starts)


class Encoder:
    """Ids as the library ``tokenizers`` gives them with ``add_special_tokens=False``.

    Ordinary text goes through the faster ``tiktoken`` with the same vocabulary; texts of scripts where the
    libraries might split differently, or that spell out a special token, through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        special = {t["content"] for t in spec.get("added_tokens", [])}
        byte = _byte_of()
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.special = path, special
        self.size = max(spec["model"]["vocab"].values()) + 1
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        # pieces in two generations: what isn't asked for while one fills up is forgotten
        self.known: dict[int, bytes] = {}
        self.before: dict[int, bytes] = {}
        # where a word begins: at a leading blank, or where no letter stands in front
        self.starts = np.ones(self.size, bool)
        for token, i in vocab.items():
            self.starts[i] = not token[0].isalpha() or token[0] in "ĠĊ"

    @cached_property
    def slow(self):
        """The library itself, loaded only where a text asks for it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> np.ndarray:
        """Ids as ``uint16`` where they fit, else ``uint32``."""
        kind = self.kind
        if any(s in text for s in self.special) or not text.isascii() and _OTHER.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, kind)
        if len(text) <= _CUT_CHARS:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(kind)
        parts, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + _CUT_CHARS) if at + _CUT_CHARS < len(text) else None
            stop = cut.start() if cut else len(text)
            parts.append(self.fast.encode_to_numpy(text[at:stop], disallowed_special=()).astype(kind))
            at = stop
        return np.concatenate(parts)

    def encode_texts(self, texts: pa.Array) -> list[np.ndarray]:
        """``encode`` of each text of a column, null as empty.

        Texts of plain Latin letters are cut into pieces all at once, on their bytes; each different piece of a chunk
        (by a 64-bit hash) is encoded once, and mostly remembered from chunks before.
        """
        out: list[np.ndarray] = []
        for first, data, offsets in text_chunks(texts, _CHUNK):
            n = len(offsets) - 1
            odd = _odd_texts(data, offsets) | (np.diff(offsets) > _CHUNK)
            if odd.any():
                column = texts.slice(first, n)
                slow = {i: self.encode(column[i].as_py() or "") for i in np.flatnonzero(odd).tolist()}
                keep = np.repeat(~odd, np.diff(offsets))
                data, offsets = data[keep], np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(offsets)))])
            else:
                slow = {}
            ids, bounds = self._fast(data, offsets)
            out += [slow[i] if i in slow else ids[bounds[i] : bounds[i + 1]] for i in range(n)]
        return out

    def _fast(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
        begin = _piece_starts(data, offsets)
        end = np.append(begin[1:], len(data))
        total, scale = running_hash(data)
        pieces = mix((total[end] - total[begin]) * scale[begin] + (end - begin).astype(np.uint64))
        del total, scale
        names, at, which = np.unique(pieces, return_index=True, return_inverse=True)
        del pieces
        if len(self.known) > _REMEMBERED:
            self.known, self.before = {}, self.known
        known, raw, names = self.known, data.tobytes(), names.tolist()
        found, code = list(map(known.get, names)), np.dtype(self.kind).char
        for i in [i for i, x in enumerate(found) if x is None]:
            k, name = at[i], names[i]
            found[i] = known[name] = self.before.get(name) or array(code, self.fast._core_bpe.encode_single_piece(raw[begin[k] : end[k]])).tobytes()
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.kind().itemsize
        flat = np.frombuffer(b"".join(found), self.kind)
        where = (np.cumsum(size) - size)[which]
        count = size[which]
        stop = np.cumsum(count)
        ids = flat[np.arange(stop[-1]) + np.repeat(where - (stop - count), count)]
        return ids, np.concatenate([[0], stop])[np.searchsorted(begin, offsets)]

    def forget(self) -> None:
        """Drop the remembered pieces; whoever only asks for ``word_starts`` has no use for them."""
        self.known, self.before = {}, {}
        tidy()

    def word_starts(self) -> np.ndarray:
        """For each id whether a word begins with it."""
        return self.starts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process and path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
