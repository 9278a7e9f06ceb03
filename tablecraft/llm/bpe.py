"""Byte-level BPE vocabulary, the split of texts into pieces, and the
transducer that a vocabulary compiles to.

``Vocabulary`` reads a ``tokenizers`` JSON file (byte-level BPE, split pattern
of the published rank files).  ``pieces`` finds the pieces of all texts of a
slice with array operations on character classes.  ``Transducer`` is a
deterministic finite-state machine over the bytes of a piece: its state tells,
for every start that a later token may still have, the last token of the
encoding up to that start and the number of tokens so far relative to here.  A
transition therefore knows how many tokens the encoding gains or loses with the
byte.  States are numbered when a text first reaches them, and the table is
built anew beyond ``MAX_STATES``, so it is bounded for any corpus.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np

from .textops import IS_CHAR

L, N, S, O = 1, 2, 3, 0          # letter, number, white space, other
MAX_STATES = 60_000


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of each code point, as the split pattern's \\p{L}, \\p{N} and \\s see it."""
    import regex
    table = np.zeros(0x110000, np.uint8)
    chars = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for cls, pat in ((L, r"\p{L}+"), (N, r"\p{N}+"), (S, r"\s+")):
        for m in regex.finditer(pat, chars):
            lo, hi = ord(chars[m.start()]), ord(chars[m.end() - 1])
            if lo < 0xD800 <= hi:                       # the gap of surrogates
                table[lo:0xD800] = cls
                lo = 0xE000
            table[lo:hi + 1] = cls
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code point, byte position) of each character of valid UTF-8 bytes."""
    at = np.flatnonzero(IS_CHAR[data])
    lead = data[at].astype(np.uint32)
    width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    cp = np.where(width == 1, lead, lead & (0xFF >> (width + 1)).astype(np.uint32))
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    for k in (1, 2, 3):
        m = np.flatnonzero(width > k)
        cp[m] = (cp[m] << np.uint32(6)) | (padded[at[m] + k] & np.uint32(0x3F))
    return cp, at


_TAIL2 = {c: k for k, c in enumerate("stmd")}
_PAIRS = (("r", "e"), ("v", "e"), ("l", "l"))


def piece_starts(data: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Byte positions where pieces start; ``cut``: start bytes of the texts (empty texts may repeat).

    Equals matching ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
    from the left in each text.
    """
    if len(data) == 0:
        return np.zeros(0, np.int64)
    cp, at = code_points(data)
    n = len(cp)
    cls = char_classes()[cp]
    first = np.zeros(n + 1, bool)              # first character of a text
    first[np.searchsorted(at, cut[cut < len(data)])] = True
    first[n] = True
    change = first[:n].copy()
    change[1:] |= cls[1:] != cls[:-1]
    start = change.copy()
    space = cls == S
    # a white-space run before a character gives up its last one, which a blank hands to that character's piece
    nxt = np.flatnonzero(change & ~space)
    nxt = nxt[(nxt > 0) & ~first[nxt]]
    nxt = nxt[space[nxt - 1]]
    start[nxt - 1] = True
    joined = nxt[cp[nxt - 1] == 0x20]
    start[joined] = False
    # contractions: an apostrophe that starts a piece
    q = np.flatnonzero((cp == 0x27) & start)
    if len(q):
        pad = np.concatenate([cp, np.zeros(3, np.uint32)])
        gone = np.concatenate([first, np.ones(3, bool)])
        one = np.isin(pad[q + 1], [ord(c) for c in "stmd"]) & ~gone[q + 1]
        two = np.zeros(len(q), bool)
        for a, b in _PAIRS:
            two |= (pad[q + 1] == ord(a)) & (pad[q + 2] == ord(b)) & ~gone[q + 1] & ~gone[q + 2]
        for hit, width in ((one, 2), (two & ~one, 3)):
            h = q[hit]
            start[h + 1] = False
            end = h + width
            end = end[end < n]
            # what follows the contraction starts a piece of its own, except where a blank already stands for it
            start[end] = True
    return at[start]


class Vocabulary:
    """Token bytes by id, and the special strings that are cut out of texts."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        visible = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
        to_byte = {chr(b): b for b in visible}
        to_byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k.encode(): v for k, v in special.items()}
        self.ids = {bytes(to_byte[c] for c in tok): i for tok, i in model["vocab"].items() if tok not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        as_bytes = lambda t: bytes(to_byte[c] for c in t)
        self.rank = {(self.ids[as_bytes(a)], self.ids[as_bytes(b)]): (k, self.ids[as_bytes(a + b)]) for k, (a, b) in enumerate(merges)}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.made = {tok: (k, a, b) for (a, b), (k, tok) in self.rank.items()}     # token -> (merge, left part, right part)
        self._byte = (-1, 0, 0)
        self._sorted = sorted(self.ids)
        self._valid: dict[tuple[int, int], bool] = {}
        self._self: dict[bytes, int | None] = {}
        self.prefixes = {t[:k] for t in self.ids for k in range(1, len(t))}

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece by merging the lowest-ranked pair until none is left."""
        out = [self.ids[piece[k:k + 1]] for k in range(len(piece))]
        while len(out) > 1:
            best = min(((self.rank.get(p, (1 << 60, 0)), k) for k, p in enumerate(zip(out, out[1:]))), default=None)
            (rank, tok), _ = best
            if rank == 1 << 60:
                break
            merged, k, pair = [], 0, None
            while k < len(out):
                if k + 1 < len(out) and self.rank.get((out[k], out[k + 1]), (None,))[0] == rank:
                    merged.append(tok)
                    k += 2
                else:
                    merged.append(out[k])
                    k += 1
            out = merged
        return out

    def whole(self, piece: bytes) -> int | None:
        """The token that is the encoding of exactly these bytes, if there is one."""
        if piece not in self._self:
            tok = self.ids.get(piece)
            self._self[piece] = tok if tok is not None and self.encode(piece) == [tok] else None
        return self._self[piece]

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand right after token a in an encoding.

        Undoes the merges next to the border from the latest to the earliest;
        the border holds unless two neighbours of some moment would have merged
        before one of them went into its own token.
        """
        key = (a, b)
        known = self._valid.get(key)
        if known is None:
            end_a = end_b = 1 << 60
            known = True
            while True:
                m = self.rank.get((a, b))
                if m is not None and m[0] < end_a and m[0] <= end_b:
                    known = False
                    break
                ra, rb = self.made.get(a, self._byte), self.made.get(b, self._byte)
                if ra[0] < 0 and rb[0] < 0:
                    break
                if ra[0] > rb[0]:
                    end_a, a = ra[0], ra[2]
                else:
                    end_b, b = rb[0], rb[1]
            self._valid[key] = known
        return known

    def longer(self, prefix: bytes) -> list[int]:
        """Tokens that start with the prefix and go on, in byte order."""
        lo = bisect_right(self._sorted, prefix)
        hi = bisect_left(self._sorted, prefix + b"\xff" * 200, lo)
        return [self.ids[t] for t in self._sorted[lo:hi]]

    def without_specials(self, data: np.ndarray, offs: np.ndarray):
        """Cuts the special strings out of the texts.

        Returns (bytes, offsets, cuts, special): texts without them, the byte
        positions where a text or a part behind a special string starts, and
        (position in the new bytes, row, id) of each special string.
        """
        raw, hits = data.tobytes(), []
        for s, tok in self.special.items():
            k = raw.find(s)
            while k >= 0:
                r = int(np.searchsorted(offs, k, "right")) - 1
                inside = k + len(s) <= offs[r + 1]
                if inside:
                    hits.append((k, len(s), r, tok))
                k = raw.find(s, k + (len(s) if inside else 1))
        if not hits:
            return data, offs, offs, np.zeros((0, 3), np.int64)
        hits.sort()
        keep = np.ones(len(data), bool)
        gone = np.zeros(len(offs), np.int64)
        special, removed = [], 0
        for k, n, r, tok in hits:
            keep[k:k + n] = False
            special.append((k - removed, r, tok))
            gone[r + 1:] += n
            removed += n
        special = np.array(special, np.int64)
        return data[keep], offs - gone, np.union1d(offs - gone, special[:, 0]), special


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Transducer:
    """The compiled machine; state 0 is the start of a piece."""

    def __init__(self, vocab: Vocabulary, max_states: int = MAX_STATES, merge_up_to: int = 160):
        self.v, self.max_states, self.merge_up_to = vocab, max_states, merge_up_to
        self.more: dict[bytes, list[int]] = {}
        self.reset()

    def reset(self) -> None:
        # state: (bytes still open, for each open start its (last token or -1, tokens so far relative to here) or None)
        start = (b"", ((-1, 0),))
        self.states, self.number = [start, None], {start: 0}
        self.lefts: dict[tuple[bytes, int], int | None] = {}
        self.same: dict[tuple, int] = {}
        self.table_rows = 1 << 10
        # next state * 256 + (tokens gained + 128); -1: not yet known; state 1 idles until a piece starts
        self.table = np.full(self.table_rows * 256, -1, np.int32)
        self.table[256:512] = 256 + 128

    def _next(self, state, byte: int):
        open_bytes, known = state
        grown = open_bytes + bytes((byte,))
        n = len(grown)
        gained = None
        for k in range(n):                              # longest token first
            if known[k] is None:
                continue
            left, count = known[k]
            tok = self.v.whole(grown[k:])
            if tok is not None and (left < 0 or self.v.follows(left, tok)):
                gained = count + 1
                break
        kept, cut = [], n
        for k in range(n):
            left = self._left(grown[k:], known[k][0]) if known[k] is not None else None
            if left is not None and cut == n:
                cut = k
            if cut <= k:
                kept.append((left, known[k][1] - gained) if left is not None else None)
        return (grown[cut:], (*kept, (tok, 0))), gained

    def _left(self, prefix: bytes, left: int) -> int | None:
        """A token that lets the same longer tokens follow as ``left`` does; None if no token can."""
        got = self.lefts.get((prefix, left), -2)
        if got != -2:
            return got
        more = self.more.get(prefix)
        if more is None:
            more = self.more[prefix] = self.v.longer(prefix) if prefix in self.v.prefixes else []
        if not more:
            got = None
        elif left < 0 or len(more) > self.merge_up_to:
            got = left
        else:
            allowed = tuple(t for t in more if self.v.follows(left, t))
            got = self.same.setdefault((prefix, allowed), left) if allowed else None
        self.lefts[prefix, left] = got
        return got

    def fill(self, keys: np.ndarray) -> None:
        """Adds the transitions for keys state * 256 + byte."""
        for key in keys.tolist():
            state, byte = divmod(key, 256)
            nxt, gained = self._next(self.states[state], byte)
            k = self.number.get(nxt)
            if k is None:
                k = self.number[nxt] = len(self.states)
                self.states.append(nxt)
                if len(self.states) > self.table_rows:
                    self.table = np.concatenate([self.table, np.full(len(self.table), -1, np.int32)])
                    self.table_rows *= 2
            self.table[key] = k * 256 + gained + 128

    def run(self, data: np.ndarray, fresh: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps all lanes (columns) of ``data`` together; ``fresh`` marks piece starts.

        Returns the lanes' last states and the tokens gained at each byte.
        """
        gained = np.empty(data.shape, np.int8)
        for t in range(len(data)):
            key = np.where(fresh[t], 0, state) * 256 + data[t]
            got = self.table[key]
            if got.min() < 0:
                self.fill(np.unique(key[got < 0]))
                got = self.table[key]
            state = got >> 8
            gained[t] = (got & 255) - 128
        return state, gained

    def count(self, data: np.ndarray, starts: np.ndarray, lane: int = 128) -> np.ndarray:
        """Tokens gained at each byte, given the piece starts; sums over a text count its tokens.

        The bytes are cut into chunks.  A chunk with a piece start maps every
        entry state to one exit state; all chunks run side by side from their
        first piece start.  The bytes before it are run from the exit of the
        chunk before, in a scan over the chunk maps: one round settles every
        chunk whose predecessor has a piece start, further rounds go on through
        pieces longer than a chunk.
        """
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int8)
        if len(self.states) > self.max_states:
            self.reset()
        lanes = -(-n // lane)
        fresh = np.zeros(lanes * lane, bool)
        fresh[starts] = True
        if n < lanes * lane:
            fresh[n] = True
        fresh = fresh.reshape(lanes, lane)
        body = np.zeros(lanes * lane, np.int32)
        body[:n] = data
        body = body.reshape(lanes, lane)
        has = fresh.any(1)
        head = np.where(has, fresh.argmax(1), lane)        # bytes before the first piece start
        out_state, gained = self.run(np.ascontiguousarray(body.T), np.ascontiguousarray(fresh.T), np.ones(lanes, np.int32))
        gained = np.ascontiguousarray(gained.T)
        todo = np.flatnonzero(head[1:] > 0) + 1
        ready = has.copy()
        while len(todo):
            now = todo[ready[todo - 1]]
            todo = todo[~ready[todo - 1]]
            state = out_state[now - 1]
            if len(now) < 8:
                for k, s in zip(now.tolist(), state.tolist()):
                    row, h = body[k].tolist(), int(head[k])
                    for t in range(h):
                        key = s * 256 + row[t]
                        got = int(self.table[key])
                        if got < 0:
                            self.fill(np.array([key]))
                            got = int(self.table[key])
                        s = got >> 8
                        gained[k, t] = (got & 255) - 128
                    if not has[k]:
                        out_state[k] = s
            else:
                order = np.argsort(-head[now], kind="stable")
                now, state = now[order], state[order]
                cols, lens = body[now], head[now]
                for t in range(int(lens[0])):
                    m = int(np.searchsorted(-lens, -t, "left"))     # lanes with more than t bytes
                    key = state[:m] * 256 + cols[:m, t]
                    got = self.table[key]
                    if got.min() < 0:
                        self.fill(np.unique(key[got < 0]))
                        got = self.table[key]
                    state[:m] = got >> 8
                    gained[now[:m], t] = (got & 255) - 128
                through = ~has[now]
                out_state[now[through]] = state[through]
            ready[now] = True
        return gained.reshape(-1)[:n]
