"""Exact byte-level BPE by backtracking over longest token matches.

A piece of text is encoded from left to right.  At each place the longest
vocabulary token is taken; a table lookup decides whether two neighbouring
tokens could stand side by side in a true merge result.  If not, shorter
tokens are tried, and when none is left the place is marked as a dead end and
the previous token is shortened.  Every place is left at most once, so the
work is linear in the length of the piece, where the textbook merge loop is
quadratic.
"""

from __future__ import annotations

import base64

import ahocorasick
import numpy as np
import regex

#: The split pattern of the byte_bpe vocabularies.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = -1


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a ``.tiktoken`` file (base64 and rank a line)."""
    ranks: dict[bytes, int] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class ByteBPE:
    """Encoder and decoder of one vocabulary whose ids are its merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = SPLIT_PATTERN):
        self.ranks = ranks
        self.findall = regex.compile(pattern).findall
        by_id = sorted(ranks.items(), key=lambda kv: kv[1])
        if [i for _, i in by_id] != list(range(len(by_id))):
            raise ValueError("ids must be 0..n-1")
        self.tokens = [t for t, _ in by_id]
        self.length = [len(t) for t in self.tokens]
        self.prefix = [self._longest_prefix(t) for t in self.tokens]
        self._pair: dict[tuple[int, int], int] = {}
        self._split: list[tuple[int, int]] = []
        self._memo: dict[tuple[int, int], bool] = {}
        for i, t in enumerate(self.tokens):
            self._split.append(self._last_merge(i, t))
        self._memo.clear()
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self._offsets = np.zeros(len(self.tokens) + 1, np.int64)
        np.cumsum(self.length, out=self._offsets[1:])
        self._bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def _longest_prefix(self, t: bytes) -> int:
        for n in range(len(t) - 1, 0, -1):
            i = self.ranks.get(t[:n])
            if i is not None:
                return i
        return _NONE

    def _last_merge(self, i: int, t: bytes) -> tuple[int, int]:
        """The pair whose merge gives token ``i``; (i, i) for a single byte."""
        left = self.prefix[i]
        while left != _NONE:
            right = self.ranks.get(t[self.length[left] :])
            if right is not None and left < i and right < i and self._compatible(left, right):
                self._pair[left, right] = i
                return left, right
            left = self.prefix[left]
        return i, i

    def _compatible(self, a: int, b: int) -> bool:
        """Would BPE leave the boundary between ``a`` and ``b`` unmerged?

        Undo merges on both sides in reverse order of rank; if at some moment
        the two tokens at the boundary had a merge of lower rank than the one
        undone, BPE would have crossed the boundary.
        """
        pair, split = self._pair, self._split
        limit = len(self.tokens) + 1
        while True:
            merged = pair.get((a, b))
            if merged is not None and merged < limit:
                return False
            if a > b:
                limit, a = a, split[a][1]
                if a == limit:
                    limit, b = b + 1, split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, split[b][0]
                if b + 1 == limit:
                    limit, a = a, split[a][1]
                    if a == limit:
                        return True

    def _fits(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self._memo.get(key)
        if known is None:
            if len(self._memo) > 1_000_000:
                self._memo.clear()
            known = self._memo[key] = self._compatible(a, b)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece (a match of the split pattern)."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        length, prefix = self.length, self.prefix
        longest = [_NONE] * n
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[i]] = i
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else _NONE
            while token != _NONE:
                end = at + length[token]
                if alive[end] and (last == _NONE or self._fits(last, token)):
                    break
                token = prefix[token]
            if token != _NONE:
                out.append(token)
                at = end
                token = longest[at] if at < n else _NONE
            else:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                alive[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``; strings that look like special tokens are ordinary text."""
        out: list[int] = []
        for piece in self.findall(text):
            out += self.encode_piece(piece.encode("utf-8", "surrogatepass"))
        return out

    def decode_bytes(self, ids) -> bytes:
        """The bytes that ``ids`` stand for, gathered through the offset table."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        sizes = self._offsets[ids + 1] - self._offsets[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self._offsets[ids] - (ends - sizes), sizes)
        return self._bytes[at].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8")


class PieceIds(dict):
    """Piece to the bytes of its int32 ids; forgets all when it holds too much."""

    def __init__(self, bpe: ByteBPE, most: int = 400_000):
        super().__init__()
        self.bpe, self.most = bpe, most

    def __missing__(self, piece: str) -> bytes:
        ids = np.asarray(self.bpe.encode_piece(piece.encode("utf-8", "surrogatepass")), np.int32).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


class PieceCounts(dict):
    """Piece to its number of ids, bounded like ``PieceIds``."""

    def __init__(self, bpe: ByteBPE, most: int = 800_000):
        super().__init__()
        self.bpe, self.most = bpe, most

    def __missing__(self, piece: str) -> int:
        n = len(self.bpe.encode_piece(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = n
        return n


_loaded: dict[str, ByteBPE] = {}


def for_worker(path: str) -> ByteBPE:
    """The encoder of ``path``, built once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(load_ranks(path))
    return _loaded[path]
