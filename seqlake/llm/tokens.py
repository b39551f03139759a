"""Token ids of whole texts by a byte-level BPE vocabulary.

A text is cut before each single space that follows something other than white
space: the pre-tokenizer cuts there as well, so the pieces' ids put together
are the text's. Pieces recur: of some texts each different piece is encoded
once. The vocabulary is read from two files of the same merges; pieces of ASCII
and Latin letters go to the faster library, put together as one text, all
others to `tokenizers`. The string of an added token is that token wherever it
stands, as a plain call has it.
"""

from __future__ import annotations

import base64
import re

import numpy as np

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END_BYTE, END_ID = b"\xff", 0
#: Stands for an added token's string; no UTF-8 text has this byte or END_BYTE.
ADDED_BYTE = b"\xfe"
#: Pieces for `tokenizers` that a worker remembers, and the longest that it does.
KEPT, LONGEST = 100_000, 256
PLAIN = re.compile("[\t-\r -~À-ȿ]*")

_K = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
#: Bytes that the UTF-8 of PLAIN's characters doesn't have.
_STRANGE = np.ones(256, bool)
_STRANGE[[*range(9, 14), *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = False


class Tokens:
    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        added = {i: t.content for i, t in self.slow.get_added_tokens_decoder().items()}
        if len(added) != 1:
            raise ValueError("a vocabulary with one added token is expected")
        ((self.added_id, content),) = added.items()
        self.added = content.encode()
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        most = max(max(table.values()), self.added_id) + 1
        #: Whether an id ends in a mark that may end a sentence, ends in a line break, begins with white space.
        self.mark, self.line, self.space = (np.zeros(most, bool) for _ in range(3))
        for raw, i in table.items():
            self.mark[i] = raw.rstrip(b"\"')] ")[-1:] in (b".", b"!", b"?")
            self.line[i] = raw.rstrip(b" ")[-1:] == b"\n"
            self.space[i] = raw[:1].isspace()
        self.space[[END_ID, self.added_id]] = True
        self.bytes_of = np.zeros(most, np.int64)
        for raw, i in table.items():
            self.bytes_of[i] = len(raw)
        self.kept: dict[bytes, np.ndarray] = {}
        self.power = np.cumprod(np.full(4096, 0x100000001B3, np.uint64), dtype=np.uint64)

    def ids(self, piece: bytes) -> np.ndarray:
        """The ids of one piece."""
        if piece == END_BYTE:
            return np.array([END_ID], "<u4")
        if piece == ADDED_BYTE:
            return np.array([self.added_id], "<u4")
        text = piece.decode("utf-8", "replace")
        if PLAIN.fullmatch(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        got = self.kept.get(piece)
        if got is None:
            got = np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
            if len(piece) <= LONGEST:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[piece] = got
        return got

    def together(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their number by piece, of plain pieces that end at `ends` in data. Each begins with a space and
        ends in something else, so that the library cuts them apart again when they are one text."""
        got = self.fast.encode_to_numpy(data.decode(), disallowed_special=()).astype("<u4")
        stop = np.searchsorted(np.cumsum(self.bytes_of[got]), ends, "right")
        return got, np.diff(np.r_[0, stop])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by END_ID, and the number of ids of each."""
        data = END_BYTE.join(texts) + END_BYTE
        if self.added in data:
            data = data.replace(self.added, ADDED_BYTE)
        raw = np.frombuffer(data, np.uint8)
        p1 = np.r_[np.uint8(255), raw[:-1]]
        p2 = np.r_[np.uint8(255), p1[:-1]]
        p3 = np.r_[np.uint8(255), p2[:-1]]
        solid = np.where(p1 < 128, ~_SPACE[p1], ((p2 >= 0xC3) & (p2 < 0xE0)) | ((p2 >= 0x80) & (p2 < 0xC0) & (p3 >= 0xE4)))
        start = np.flatnonzero(((raw == 32) & solid) | (raw >= 254) | (p1 >= 254))
        length = np.diff(np.r_[start, len(raw)])
        every = np.arange(len(raw), dtype=np.int32 if len(raw) < 1 << 31 else np.int64)
        place = every - np.repeat(start.astype(every.dtype), length)
        hashed = np.add.reduceat((raw + np.uint64(1)) * self.power[place & 4095], start) * _K + length.astype(np.uint64)
        _, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        # Pieces of one hash are one piece where their bytes are equal; any other stands for itself.
        model = start[first][which]
        same = length[first][which] == length
        model[~same] = start[~same]
        place += np.repeat(model.astype(every.dtype), length)
        same &= np.logical_and.reduceat(raw[place] == raw, start)
        if not same.all():
            odd = np.flatnonzero(~same)
            which = which.copy()
            which[odd] = len(first) + np.arange(len(odd))
            first = np.r_[first, odd]
        opens = raw[start] == 32
        joins = opens & np.r_[opens[1:], False]
        strange = _STRANGE[raw]
        if np.count_nonzero(strange) > len(texts):
            joins &= ~np.logical_or.reduceat(strange, start)
        joins = joins[first]
        many = np.zeros(len(first), np.int64)
        begin, size = start[first], length[first]
        own = size[joins]
        ends = np.cumsum(own)
        got, many[joins] = self.together(raw[np.repeat(begin[joins] - (ends - own), own) + np.arange(ends[-1])].tobytes(), ends) if len(own) else (np.zeros(0, "<u4"), 0)
        alone = np.flatnonzero(~joins)
        others = [self.ids(data[a : a + n]) for a, n in zip(begin[alone].tolist(), size[alone].tolist())]
        many[alone] = np.fromiter(map(len, others), np.int64, len(others))
        flat = np.concatenate([got, *others])
        order = np.r_[np.flatnonzero(joins), alone]
        lead = np.empty(len(first), np.int64)
        lead[order] = np.cumsum(many[order]) - many[order]
        count = many[which]
        before_ = np.cumsum(count) - count
        ids = flat[np.arange(int(count.sum())) + np.repeat(lead[which] - before_, count)]
        ends = np.flatnonzero(raw[start] == 255)
        total = before_[ends] + 1
        return ids, np.diff(np.r_[0, total])


_tokens: dict[str, Tokens] = {}


def tokens(vocabulary: str, ranks: str, pattern: str) -> Tokens:
    """One a worker process and vocabulary."""
    if vocabulary not in _tokens:
        _tokens[vocabulary] = Tokens(vocabulary, ranks, pattern)
    return _tokens[vocabulary]
