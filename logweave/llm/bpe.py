"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

Encoding has two stages, both streaming. The splitter cuts a text into pre-tokens and holds
back only what later characters could still change. The merger turns a pre-token's bytes into
tokens. Short pre-tokens are merged whole (and remembered in a bounded table); a pre-token of
any length is merged through a window: `lookahead(merges)` bytes are enough to settle a
token, so tokens that end that far before the window's end are emitted and forgotten.

Why the lookahead suffices: a token is built or consumed by merges in rank order, and a
right-hand neighbour can only prevent a merge by joining something else under a lower rank
first. Following those prevented merges gives chains of falling rank, whose longest byte
length a single pass over the merge list, in rank order, bounds for every token.

Decoding is a state machine that carries at most three bytes of an unfinished character.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator

import regex

#: Pre-token classes: contractions, then runs with one optional leading space, then blanks.
#: Fixed by the vocabulary file's pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Characters of a text that the splitter looks at together.
CHUNK = 1 << 16
#: Pre-tokens longer than this many bytes go through the window.
LONG = 256
#: Entries of each of the two tables of remembered pre-tokens; a full one replaces the older,
#: so pre-tokens in use stay known.
REMEMBERED = 300_000


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins that byte-level vocabularies write for the 256 byte values."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def lookahead(merges: Iterable[tuple[int, int, int]], lengths: dict[int, int]) -> int:
    """Bytes that settle any token, from (left, right, joined) in rank order.

    need[t] bounds the bytes, from t's first, that decide whether t stands there under the
    merges seen so far.
    """
    need = dict(lengths)
    for left, right, joined in merges:
        reach = lengths[left] + need[right]
        need[joined] = max(need.get(joined, 0), reach)
        need[left] = max(need[left], reach)
    return max(need.values(), default=1)


class Bpe:
    """Encoder and decoder for one byte-level vocabulary file (Hugging Face JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        sym = byte_symbols()
        vocab = spec["model"]["vocab"]
        raw = {tok: bytes(sym[c] for c in tok) for tok in vocab if all(c in sym for c in tok)}
        self.token_bytes: dict[int, bytes] = {vocab[tok]: b for tok, b in raw.items()}
        self.byte_ids = [0] * 256
        for c, b in sym.items():
            self.byte_ids[b] = vocab[c]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        listed = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.pairs = {(a, b): (rank, ab) for rank, (a, b, ab) in reversed(list(enumerate(listed)))}
        self.lookahead = lookahead(listed, {i: len(b) for i, b in self.token_bytes.items()})
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._split = regex.compile(PATTERN)
        self._runs = [regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", r"[^\p{White_Space}\p{L}\p{N}]*", r"\p{White_Space}*")]
        self._known: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    # ---- merging -------------------------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """Tokens of one whole pre-token: the lowest rank first, leftmost among equals."""
        ids = [self.byte_ids[b] for b in data]
        pairs, none = self.pairs, (1 << 30, 0)
        found = [pairs.get(p, none) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            ids[i] = best[1]
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = pairs.get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = pairs.get((ids[i], ids[i + 1]), none)
        return ids

    def merge_stream(self, parts: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of one pre-token that arrives in parts, in constant memory."""
        held = b""
        window = 4 * self.lookahead
        for part in parts:
            for at in range(0, len(part), window):
                held += part[at : at + window]
                if len(held) < 2 * window:
                    continue
                settled, end, out = len(held) - self.lookahead, 0, []
                for t in self.merge_window(held):
                    if end + len(self.token_bytes[t]) > settled:
                        break
                    end += len(self.token_bytes[t])
                    out.append(t)
                held = held[end:]
                yield out
        if held:
            yield self.merge_window(held)

    def merge_window(self, data: bytes) -> list[int]:
        """As merge(), with a heap of candidate pairs: near-linear for long windows."""
        from heapq import heapify, heappop, heappush

        n = len(data)
        ids: list[int | None] = [self.byte_ids[b] for b in data]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1])))]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = nxt[i] if ids[i] is not None else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = pairs[a, b][1], None
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if r := pairs.get((ids[i], ids[k])):
                    heappush(heap, (r[0], i, ids[i], ids[k]))
            if (h := prv[i]) >= 0 and (r := pairs.get((ids[h], ids[i]))):
                heappush(heap, (r[0], h, ids[h], ids[i]))
        return [t for t in ids if t is not None]

    def word(self, word: str) -> tuple[int, ...]:
        """Tokens of a short pre-token, remembered."""
        if (got := self._known.get(word)) is None:
            if (got := self._older.get(word)) is None:
                got = tuple(self.merge(word.encode("utf-8", "surrogatepass")))
            if len(self._known) >= REMEMBERED:
                self._known, self._older = {}, self._known
            self._known[word] = got
        return got

    # ---- splitting -----------------------------------------------------------------

    def _class(self, c: str) -> int:
        return next(i for i, r in enumerate(self._runs) if r.fullmatch(c) and c)

    def pieces(self, text: str, chunk: int = CHUNK) -> Iterator[list[str] | Iterator[str]]:
        """Pre-tokens of a text without special tokens: lists of whole short ones, and for a
        long one an iterator over its parts, to be read before the next item."""
        at, n, chunk = 0, len(text), max(16, chunk)  # longer than any contraction
        while at < n:
            end = min(n, at + chunk)
            found = self._split.findall(text, at, end)
            if end < n and len(found) == 2 and len(found[1]) > 2:
                found.pop()  # what follows is known: the first is settled
                end = at + len(found[0])
            elif end < n:
                # the last two can still change: a run can go on, a contraction can form
                for w in (found.pop(), found.pop() if found else ""):
                    end -= len(w)
            if end > at:
                yield found
                at = end
                continue
            # one run fills the chunk: hand it on part by part
            yield (parts := self._run(text, at, chunk))
            for _ in parts:
                pass
            at = self._at

    def _run(self, text: str, at: int, chunk: int) -> Iterator[str]:
        c = text[at]
        lead = 1 if c == " " and at + 1 < len(text) and not self._runs[3].fullmatch(text[at + 1]) else 0
        kind = self._class(text[at + lead])
        blank = self._runs[3]
        begin, at = at, at + lead
        while True:
            end = min(len(text), at + chunk)
            stop = self._runs[kind].match(text, at, end).end()
            if kind == 3 and stop < len(text) and not blank.fullmatch(text[stop]):
                stop -= 1  # the last blank belongs to what follows
            if stop > begin:
                yield text[begin:stop]
            self._at = begin = at = stop
            if stop < end or stop == len(text):
                return

    def _segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        at = 0
        if self._special and any(s in text for s in self.special):
            for m in self._special.finditer(text):
                yield text[at : m.start()], self.special[m.group()]
                at = m.end()
        yield (text[at:] if at else text), None

    def encode_stream(self, text: str, chunk: int = CHUNK) -> Iterator[list[int]]:
        """Token ids, in batches."""
        for segment, special in self._segments(text):
            for item in self.pieces(segment, chunk):
                if isinstance(item, list):
                    out: list[int] = []
                    for w in item:
                        got = self._known.get(w)
                        if got is None:
                            if len(w) > LONG:
                                yield out
                                out = []
                                yield from self.merge_stream([w.encode("utf-8", "surrogatepass")])
                                continue
                            got = self.word(w)
                        out += got
                    yield out
                else:
                    yield from self.merge_stream(p.encode("utf-8", "surrogatepass") for p in item)
            if special is not None:
                yield [special]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for ids in self.encode_stream(text):
            out += ids
        return out

    # ---- decoding ------------------------------------------------------------------

    def decode_stream(self, batches: Iterable[list[int]]) -> Iterator[str]:
        """Text of token ids; invalid sequences become U+FFFD, as in lossy UTF-8 decoding."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        raw = self.token_bytes.__getitem__
        for ids in batches:
            yield state.decode(b"".join(map(raw, ids)))
        yield state.decode(b"", True)


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary of a file, read once per process."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def fast_encoder(path: str):
    """text -> uint32 ids, the same as Bpe.encode, by the compiled encoder where it fits: the
    vocabulary numbers its merges in rank order, and the text has no run so long that a whole
    pre-token would be heavy; such texts go through the streaming encoder."""
    import numpy as np
    import tiktoken

    own = load(path)
    by_rank = sorted((rank, joined) for rank, joined in own.pairs.values())
    if any(x[1] >= y[1] for x, y in zip(by_rank, by_rank[1:])):
        return lambda text: np.array(own.encode(text), dtype=np.uint32)
    ordinary = {b: i for i, b in own.token_bytes.items() if i not in own.special.values()}
    compiled = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ordinary, special_tokens=own.special)
    heavy = regex.compile(r"\S{4096}|\s{4096}")

    def encode(text: str):
        if heavy.search(text):
            return np.array(own.encode(text), dtype=np.uint32)
        return compiled.encode_to_numpy(text, allowed_special="all")

    return encode
