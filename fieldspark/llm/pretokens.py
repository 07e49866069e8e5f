"""Pre-tokens of byte-level vocabularies, found with array operations instead of a regular expression.

Every code point has a class, and each class is a transition function on a few states: what the code
point before belongs to. Composing functions is associative, so the states after all code points come
from a blocked scan: compose within blocks side by side, run over the blocks' functions, then replay
each block from its true first state. State and class then say where a pre-token starts.

The split is the one of the published pattern: contractions after an apostrophe, runs of letters, of
numbers or of other signs with one blank before them, and white space, of which a last plain blank goes
to the next pre-token.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import unicodedata
from collections.abc import Callable

import numpy as np

from .text import byte_windows, mixed, span_word

# Classes of code points.
LETTER, NUMBER, BLANK, SPACE, OTHER, SHORT, LONG = range(7)
# States: what stands before. DONE is also the start of a document; IN1 and IN2 wait for letters of a contraction.
DONE, AFTER_LETTER, AFTER_NUMBER, AFTER_BLANK, AFTER_SPACE, AFTER_OTHER, IN1, IN2 = range(8)
# White space by the Unicode property of that name, as code points.
WHITE_SPACE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# What may follow an apostrophe as a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_classes: np.ndarray | None = None


def code_point_classes() -> np.ndarray:
    """The class of every code point, made once per process."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        out[list(WHITE_SPACE)] = SPACE
        out[0x20] = BLANK
        _classes = out
    return _classes


def _transitions() -> np.ndarray:
    """next state = table[symbol, state]; symbols 7..13 are the classes at a document's first code point."""
    after = {LETTER: AFTER_LETTER, NUMBER: AFTER_NUMBER, BLANK: AFTER_BLANK, SPACE: AFTER_SPACE, OTHER: AFTER_OTHER}
    out = np.zeros((14, 8), np.uint8)
    for symbol in range(7):
        for state in range(8):
            if state in (IN1, IN2):
                to = DONE if state == IN1 else IN1
            elif symbol in (SHORT, LONG):
                to = AFTER_OTHER if state in (AFTER_BLANK, AFTER_OTHER) else (IN1 if symbol == SHORT else IN2)
            else:
                to = after[symbol]
            out[symbol, state] = to
        out[symbol + 7] = out[symbol, DONE]
    return out


def _starts() -> np.ndarray:
    """Whether a pre-token starts at a code point, by symbol and the state before it (white space apart)."""
    out = np.ones((14, 8), bool)
    for symbol, own in ((LETTER, AFTER_LETTER), (NUMBER, AFTER_NUMBER), (OTHER, AFTER_OTHER), (SHORT, AFTER_OTHER), (LONG, AFTER_OTHER)):
        out[symbol, [own, AFTER_BLANK, IN1, IN2]] = False
    return out


TRANSITIONS, STARTS = _transitions(), _starts()


def scanned_states(symbols: np.ndarray, width: int = 512) -> np.ndarray:
    """The state before each symbol, by an associative scan over transition functions."""
    n = len(symbols)
    blocks = -(-n // width) if n else 0
    grid = np.zeros((width, blocks), np.uint8)
    padded = np.full(blocks * width, OTHER, np.uint8)
    padded[:n] = symbols
    grid[:] = padded.reshape(blocks, width).T
    # Each block's function, as the state it leads to from every state.
    flat = TRANSITIONS.ravel()
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    shifted = grid * np.uint8(8)
    for k in range(width):
        whole = flat[shifted[k][:, None] + whole]
    first = np.zeros(blocks, np.uint8)
    state = DONE
    for b, f in enumerate(whole.tolist()):
        first[b] = state
        state = f[state]
    out = np.empty((width, blocks), np.uint8)
    now = first
    for k in range(width):
        out[k] = now
        now = flat[shifted[k] + now]
    return out.T.ravel()[:n]


def pretoken_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Byte positions at which pre-tokens start, in a chunk of UTF-8 documents (see ``text.chunks``)."""
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    places = np.flatnonzero((data & 0xC0) != 0x80)
    bounds = np.searchsorted(places, ends)
    symbols = code_point_classes()[points]
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    # Contractions: the apostrophe's class says how many letters follow it.
    for at in np.flatnonzero(points == 39):
        limit = bounds[np.searchsorted(bounds, at, "right")]
        following = "".join(map(chr, points[at + 1 : min(at + 3, limit)]))
        fit = next((c for c in CONTRACTIONS if following.startswith(c)), None)
        if fit:
            symbols[at] = SHORT if len(fit) == 1 else LONG
    marked = symbols + np.uint8(7) * first[:-1]
    states = scanned_states(marked)
    out = STARTS[marked, states]
    white = (symbols == BLANK) | (symbols == SPACE)
    # White space: the first of a run starts a pre-token, and the last one if a sign follows.
    sign_follows = np.zeros(n, bool)
    sign_follows[:-1] = ~white[1:] & ~first[1:-1]
    begins = np.ones(n, bool)
    begins[1:] = ~white[:-1] | first[1:-1]
    np.copyto(out, begins | sign_follows, where=white)
    return places[out]


class PieceCache:
    """Ids of pre-tokens, kept by their bytes in a table of fixed size.

    A pre-token of up to 16 bytes has one place in the table, where its bytes and its length stand; a new one
    there replaces the old. A longer one is kept in a dictionary, which is emptied when it is full. Those that neither holds are
    encoded once per chunk. Ids are only ever taken from a pre-token with the same bytes.
    """

    def __init__(self, encode_missing: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], slots: int = 1 << 20, most: int = 6, most_long: int = 1 << 16) -> None:
        self.encode_missing, self.most, self.most_long = encode_missing, most, most_long
        self.mask = np.uint64(slots - 1)
        # Bytes 0 to 7 and 8 to 15 as numbers, and the length (0: nothing here).
        self.low, self.high, self.lengths = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.uint8)
        self.sizes = np.zeros(slots, np.uint8)
        self.ids = np.zeros((slots, most), np.uint32)
        self.long: dict[bytes, np.ndarray] = {}

    def ids_of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For a chunk: all ids, their bounds per document, starts of the slices, their bounds per document, ids per slice."""
        starts = pretoken_starts(data, ends)
        stops = np.append(starts[1:], len(data))[: len(starts)]
        n = stops - starts
        windows = byte_windows(data)
        low, high = (span_word(windows, starts, n, k) for k in range(2))
        with np.errstate(over="ignore"):
            slot = (mixed(low ^ mixed(high + n.astype(np.uint64))) & self.mask).astype(np.int64)
        # No place has a length above 16, so that longer ones are never held here.
        missing = np.flatnonzero((self.low[slot] != low) | (self.high[slot] != high) | (self.lengths[slot] != n))
        sizes = self.sizes[slot].astype(np.int64)
        new_ids = np.zeros(0, np.uint32)
        if len(missing):
            raw = data.tobytes()
            which_of: dict[bytes, int] = {}
            which = np.fromiter((which_of.setdefault(raw[x:y], len(which_of)) for x, y in zip(starts[missing].tolist(), stops[missing].tolist())), np.int64, len(missing))
            pieces = list(which_of)
            flat, counts = self._encoded(pieces)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            sizes[missing] = counts[which]
            new_ids = flat[gathered(offsets[:-1][which], counts[which])]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.empty(bounds[-1], np.uint32)
        known = np.ones(len(starts), bool)
        known[missing] = False
        held = np.flatnonzero(known)
        # The k-th id of every held pre-token at once.
        for k in range(self.most):
            held = held[sizes[held] > k]
            if not len(held):
                break
            ids[bounds[held] + k] = self.ids[slot[held], k]
        if len(missing):
            ids[gathered(bounds[missing], sizes[missing])] = new_ids
            first = np.empty(len(pieces), np.int64)
            first[which[::-1]] = missing[::-1]
            keep = np.flatnonzero((counts <= self.most) & (counts > 0) & (n[first] <= 16))
            # Of several for one place the last is written, in every column.
            at, place = first[keep], slot[first[keep]]
            self.low[place], self.high[place], self.lengths[place], self.sizes[place] = low[at], high[at], n[at], counts[keep]
            for k in range(self.most):
                has = counts[keep] > k
                self.ids[place[has], k] = flat[offsets[keep[has]] + k]
        slice_bounds = np.searchsorted(starts, ends)
        return ids, bounds[slice_bounds], starts, slice_bounds, sizes

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces one after another, and how many each has; long ones from the dictionary where it has them."""
        new = [i for i, p in enumerate(pieces) if p not in self.long]
        flat, counts = self.encode_missing([pieces[i] for i in new])
        if len(new) == len(pieces):
            runs = None
        else:
            runs = [self.long.get(p) for p in pieces]
        ends = np.cumsum(counts).tolist()
        for i, stop, count in zip(new, ends, counts.tolist()):
            own = flat[stop - count : stop]
            if runs is not None:
                runs[i] = own
            if len(pieces[i]) > 16:
                if len(self.long) >= self.most_long:
                    self.long.clear()
                # Very long ones would make the dictionary's size depend on the texts.
                if len(pieces[i]) <= 256:
                    self.long[pieces[i]] = own.copy()
        if runs is None:
            return flat, counts
        return np.concatenate(runs), np.fromiter(map(len, runs), np.int64, len(runs))


def gathered(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


_tokenizers: dict[bytes, PieceCache] = {}


class AddedTokenCache:
    """A cache that gives added tokens their own ids, as the library does unless told otherwise.

    Texts are cut at the strings of the added tokens; what stands between them goes through the cache.
    """

    def __init__(self, cache: PieceCache, added: dict[str, int]) -> None:
        self.cache, self.added = cache, added
        # Of two that begin at one place the longest is taken.
        self.any = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(added, key=len, reverse=True)))

    def ids_of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a chunk: all ids and their bounds per document."""
        raw = data.tobytes()
        hits = list(self.any.finditer(raw)) if self.added else []
        # A string over the end of a document is none; the next may begin inside it.
        if any(np.searchsorted(ends, m.start(), "right") != np.searchsorted(ends, m.end(), "left") for m in hits):
            hits = [m for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()) for m in self.any.finditer(raw, a, b)]
        if not hits:
            return self.cache.ids_of(data, ends)[:2]
        kept = np.ones(len(data), bool)
        for m in hits:
            kept[m.start() : m.end()] = False
        # The parts between hits and document ends are documents of their own to the cache.
        shift = np.concatenate([[0], np.cumsum(kept)])
        at = np.array([m.start() for m in hits])
        cuts = np.concatenate([ends, at])
        order = np.argsort(cuts, kind="stable")
        ids, bounds = self.cache.ids_of(data[kept], shift[cuts[order]])[:2]
        place = np.empty(len(cuts), np.int64)
        place[order] = bounds
        before = place[len(ends) :]
        out = np.insert(ids, before, np.array([self.added[m.group().decode()] for m in hits], ids.dtype))
        return out, place[: len(ends)] + np.searchsorted(at, ends, "left")


def library_cache(definition: bytes) -> PieceCache:
    """A cache in front of the tokenizers library, one per process and tokenizer.

    The library's byte-level tokenizers split text by the pattern above and treat each pre-token
    by itself, so the ids of a text are those of its pre-tokens in a row. The library gets the missing
    pre-tokens as lines of one text: a line end between two signs is a pre-token by itself. Added
    tokens' strings are ordinary text here, see :func:`added_token_cache`.
    """
    key = hashlib.sha256(definition).digest()
    if key not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(definition.decode("utf-8"))
        tok.encode_special_tokens = True
        (line_end,) = tok.encode("\n", add_special_tokens=False).ids

        def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            blank = [i for i, p in enumerate(pieces) if p.isspace() or p.decode("utf-8").isspace()] if any(not p.strip() or p[-1] >= 0x80 for p in pieces) else []
            apart = set(blank)
            lines = [p for i, p in enumerate(pieces) if i not in apart]
            runs: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(pieces)
            flat, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
            if lines:
                ids = np.array(tok.encode_batch_fast([b"\n".join([*lines, b""]).decode("utf-8")], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(ids == line_end)
                flat, counts = ids[ids != line_end], np.diff(np.concatenate([[-1], cuts])) - 1
            if not blank:
                return flat, counts
            offsets = np.concatenate([[0], np.cumsum(counts)])
            it = iter(range(len(lines)))
            for i in range(len(pieces)):
                if i not in apart:
                    k = next(it)
                    runs[i] = flat[offsets[k] : offsets[k + 1]]
            for i in blank:
                runs[i] = np.array(tok.encode(pieces[i].decode("utf-8"), add_special_tokens=False).ids, np.uint32)
            return np.concatenate(runs), np.fromiter(map(len, runs), np.int64, len(runs))

        _tokenizers[key] = PieceCache(encode)
    return _tokenizers[key]


_added: dict[bytes, AddedTokenCache] = {}


def added_token_cache(definition: bytes) -> AddedTokenCache:
    """Ids as of the library's ``encode(text, add_special_tokens=False)``, one cache per process and tokenizer."""
    key = hashlib.sha256(definition).digest()
    if key not in _added:
        from tokenizers import Tokenizer

        cache = library_cache(definition)
        tokens = Tokenizer.from_str(definition.decode("utf-8")).get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in tokens.values()):
            raise ValueError("added tokens that take blanks, need word ends or are normalized are not supported")
        _added[key] = AddedTokenCache(cache, {t.content: i for i, t in tokens.items()})
    return _added[key]
