"""Byte-level BPE compiled to finite-state machines.

Two machines are compiled from a tokenizer file:

* a *splitter*: a deterministic transducer over character classes (with one symbol of look-ahead) that marks
  where a pre-token starts.  A text is cut into fixed-size chunks; every chunk is run from all entry states at
  once, which gives its state map; the maps compose by a parallel prefix scan, which gives each chunk's true
  entry state, and one last run from there marks the starts.
* a *count transducer* over the bytes of one pre-token: a state holds, for every suffix that may still become a
  token, the last token of the encoding that ends there and how many tokens it has less than the current one;
  each transition is annotated with the tokens it emits.  States are determinised lazily up to a fixed number; beyond it
  a run goes on without adding states, as in lazy DFA matchers, so junk text cannot make the table grow.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np

from quillmask.llm import pieces

# ---- character classes ---------------------------------------------------------------------------------------
#: (MARK and REST: the first and the other characters of a special string)
END, LETTER, SHORT, C_R, C_V, C_E, C_L, NUMBER, SPACE, BLANK, OTHER, QUOTE, MARK, REST = range(14)
_CLASSES = 14
#: what follows: anything that is no white space, an "e", an "l", white space or the end
_NONE, _E, _EL, _GAP = range(4)
#: states
S0, IN_LETTER, IN_NUMBER, IN_OTHER, IN_BLANK, PREFIX, QUOTED, SUFFIX, CLOSED = range(9)
STATES = 9
_PROBED = 0x40000  # planes 4 to 16 hold no letters, digits or white space
CHUNK = 256


def _load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path}: only byte-level BPE without prefix space is compiled")
    if spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError(f"{path}: normalizers, dropout and ignore_merges are not compiled")
    return spec


@lru_cache(maxsize=4)
def class_table(path: str) -> bytes:
    """zlib-packed class of each code point, probed from the library so that its Unicode version is the one used."""
    from tokenizers import Tokenizer

    _load(path)
    pre = Tokenizer.from_file(path).pre_tokenizer
    table = np.full(_PROBED + 1, OTHER, np.uint8)
    for lo in range(0, _PROBED, 0x8000):
        points = [c for c in range(lo, lo + 0x8000) if not 0xD800 <= c < 0xE000]
        joined = {}
        for lead in "a1!":
            probe = "".join(f"{lead}{chr(c)}\n" for c in points)
            starts = np.zeros(len(probe) + 1, bool)
            starts[[span[0] for _, span in pre.pre_tokenize_str(probe)]] = True
            joined[lead] = ~starts[1 : 3 * len(points) : 3]
        at = np.array(points)
        kind = np.where(joined["a"], LETTER, np.where(joined["1"], NUMBER, np.where(joined["!"], OTHER, BLANK)))
        table[at] = kind
    for chars, kind in (("stmd", SHORT), ("r", C_R), ("v", C_V), ("e", C_E), ("l", C_L), (" ", SPACE), ("'", QUOTE)):
        for c in chars:
            table[ord(c)] = kind
    return zlib.compress(table.tobytes())


def _compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a pre-token) by state and symbol, where a symbol is class * 4 + what follows."""
    to = np.zeros((STATES, _CLASSES * 4), np.uint8)
    mark = np.zeros((STATES, _CLASSES * 4), bool)
    letters = {LETTER, SHORT, C_R, C_V, C_E, C_L}
    for state in range(STATES):
        for kind in range(_CLASSES):
            for ahead in range(4):
                if kind in (END, MARK, REST):
                    nxt, start = S0, kind == MARK
                elif kind in (SPACE, BLANK):
                    last = ahead != _GAP
                    start = state != IN_BLANK or last
                    nxt = PREFIX if kind == SPACE and last else IN_BLANK
                elif kind in letters:
                    nxt = IN_LETTER
                    start = state not in (IN_LETTER, PREFIX)
                    if state == SUFFIX:
                        nxt, start = CLOSED, False
                    elif state == QUOTED and kind == SHORT:
                        nxt, start = CLOSED, False
                    elif state == QUOTED and (kind in (C_R, C_V) and ahead == _E or kind == C_L and ahead == _EL):
                        nxt, start = SUFFIX, False
                elif kind == NUMBER:
                    nxt, start = IN_NUMBER, state not in (IN_NUMBER, PREFIX)
                elif kind == QUOTE and state not in (IN_OTHER, PREFIX, QUOTED):
                    nxt, start = QUOTED, True
                else:
                    nxt, start = IN_OTHER, state not in (IN_OTHER, PREFIX, QUOTED)
                to[state, kind * 4 + ahead], mark[state, kind * 4 + ahead] = nxt, start
    return to, mark


_TO, _MARK = _compile_splitter()
_AHEAD = np.array([_GAP if k in (END, SPACE, BLANK, MARK, REST) else _E if k == C_E else _EL if k == C_L else _NONE for k in range(_CLASSES)], np.uint8)


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix composition: row k becomes maps[k] after maps[k-1] after ... maps[0]."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


_WIDTH = _CLASSES * 4
_ROW = _TO.ravel().astype(np.intp) * _WIDTH  # next state as the offset of its row


def chunk_maps(symbols: np.ndarray) -> np.ndarray:
    """State map of each column of symbols (length x chunks): exit state for every entry state.

    Maps soon become constant; from then on such a chunk is run once instead of from every state.
    """
    length, n = symbols.shape
    state = np.repeat(np.arange(STATES, dtype=np.intp)[:, None] * _WIDTH, n, axis=1)
    head = min(6, length)
    for j in range(head):
        state = np.take(_ROW, state + symbols[j])
    same = (state == state[0]).all(axis=0)
    one, rest = state[0, same], state[:, ~same]
    merged, others = np.ascontiguousarray(symbols[:, same]), np.ascontiguousarray(symbols[:, ~same])
    for j in range(head, length):
        one = np.take(_ROW, one + merged[j])
        if others.size:
            rest = np.take(_ROW, rest + others[j])
    out = np.empty((n, STATES), np.intp)
    out[same] = one[:, None] // _WIDTH
    out[~same] = rest.T // _WIDTH
    return out


def starts(kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, for the classes of a text (END separates texts)."""
    n = len(kinds)
    if not n:
        return np.zeros(0, bool)
    rows = -(-n // CHUNK)
    symbols = np.full(rows * CHUNK, END * 4 + _GAP, np.uint8)
    np.multiply(kinds, 4, out=symbols[:n])
    symbols[: n - 1] += _AHEAD[kinds[1:]]
    symbols[n - 1] += _GAP
    grid = symbols.reshape(rows, CHUNK).T.astype(np.intp, order="C")
    entry = np.zeros(rows, np.intp)
    if rows > 1:
        entry[1:] = compose_scan(chunk_maps(grid[:, :-1]))[:, S0] * _WIDTH
    mark, out = _MARK.ravel(), np.empty((CHUNK, rows), bool)
    for j in range(CHUNK):
        at = entry + grid[j]
        out[j] = mark[at]
        entry = np.take(_ROW, at)
    return np.ascontiguousarray(out.T).ravel()[:n]


def parts(column, size: int = 1_000_000):
    """(first row, texts) of parts of an Arrow column of about so many bytes; nulls are empty.  Only one part is held as strings."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield lo, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
        lo = hi


class Splitter:
    """Cuts texts into pre-tokens; special strings are pieces of their own."""

    def __init__(self, path: str, packed: bytes):
        spec = _load(path)
        self.table = np.frombuffer(zlib.decompress(packed), np.uint8)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])) or len(self.special) > 1:
            raise ValueError(f"{path}: only one plain special string is compiled")

    def batches(self, texts, chars: int = 1_000_000):
        """Yields (index of the first text, groups()) of about so many characters."""
        at, size, part = 0, 0, []
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= chars:
                yield at, self.groups(part)
                at, size, part = at + len(part), 0, []
        if part:
            yield at, self.groups(part)

    def groups(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(different pre-tokens, index of each pre-token in them, number of pre-tokens by text).

        Equal pre-tokens of a batch are found by hash and compared byte by byte.
        """
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = np.take(self.table, points, mode="clip")
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        kinds[ends] = END
        for special in self.special:
            at = joined.find(special)
            while at >= 0:
                kinds[at], kinds[at + 1 : at + len(special)] = MARK, REST
                at = joined.find(special, at + len(special))
        begin = starts(kinds)
        begin[ends] = True
        edge = np.flatnonzero(begin)  # each text's end is an edge too
        own = np.ones(len(edge), bool)
        last = np.searchsorted(edge, ends)
        own[last] = False
        counts = np.diff(np.concatenate(([-1], last))) - 1
        first, stop = edge[own], np.append(edge[1:], len(points))[own]
        data = pieces.buffer(joined.encode("utf-8"))
        if len(data) == len(points) + pieces.SPARE:  # ASCII: places of characters are those of bytes
            index, inverse = pieces.distinct(data, first, stop - first)
        else:
            at = np.concatenate(([0], np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))))
            index, inverse = pieces.distinct(data, at[first], at[stop] - at[first])
        return [joined[a:b] for a, b in zip(first[index].tolist(), stop[index].tolist())], inverse, counts


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}


class CountTransducer:
    """tokens(piece): how many tokens byte-pair merging makes of a pre-token, in time linear in its bytes."""

    def __init__(self, path: str, max_states: int = 20_000, max_words: int = 240_000):
        spec = _load(path)
        stand_in = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(stand_in[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        vocab = spec["model"]["vocab"]
        self.merge = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.max_states, self.max_words = max_states, max_words
        self.longest = max(map(len, self.id_of))
        # every prefix of a token is a node; a token that merging never makes as a whole is left out
        self.node_of: dict[bytes, int] = {b"": 0}
        self.text_of: list[bytes] = [b""]
        for token in self.id_of:
            for k in range(1, len(token) + 1):
                if (head := token[:k]) not in self.node_of:
                    self.node_of[head] = len(self.text_of)
                    self.text_of.append(head)
        self.parts = {made: (rank, a, b) for (a, b), (rank, made) in self.merge.items()}
        self._spines = [lru_cache(maxsize=None)(lambda t, side=side: tuple(self._spine(t, side))) for side in (0, 1)]  # one entry a token at most
        self._moves: dict[int, int] = {}  # nodes x bytes at most; what texts use of it
        self._pairs: dict[tuple[int, int], bool] = {}
        self._ends: dict[int, tuple[tuple[int, int], ...]] = {}
        self.special = special
        self.words = _Words(self.tokens, max_words)
        start = (0, ((-1, 0),))
        self.states, self.known, self.table = [start], {start: 0}, {}

    def bpe(self, data: bytes) -> list[int]:
        """Plain merging by rank: the definition, used for strings of two tokens at most."""
        ids = [self.id_of[data[k : k + 1]] for k in range(len(data))]
        while len(ids) > 1:
            best = min((self.merge.get(p, (1 << 60, -1)) for p in zip(ids, ids[1:])), default=(1 << 60, -1))
            if best[1] < 0:
                break
            k, out = 0, []
            while k < len(ids):
                if k + 1 < len(ids) and self.merge.get((ids[k], ids[k + 1])) == best:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of a token that stand at its left (0) or right (1) edge while it is merged, each with the rank that consumes it."""
        out, consumed = [(token, float("inf"))], 0.0
        while (made := self.parts.get(token)) is not None:
            consumed, token = made[0], made[1 + side]
            out.append((token, consumed))
        return out

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging keeps this pair of tokens: no pair of their edge parts merges before either part is consumed."""
        key = (left, right)
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            known = True
            for p, p_gone in self._spines[1](left):
                for q, q_gone in self._spines[0](right):
                    if (m := self.merge.get((p, q))) is not None and m[0] < p_gone and m[0] <= q_gone:
                        known = False
            self._pairs[key] = known
        return known

    def _endings(self, node: int) -> tuple[tuple[int, int], ...]:
        """(token, length) of the tokens that end at a node, longest first."""
        if (known := self._ends.get(node)) is None:
            text, found = self.text_of[node], []
            for k in range(len(text)):
                if (token := self.id_of.get(text[k:])) is not None and self.bpe(text[k:]) == [token]:
                    found.append((token, len(text) - k))
            known = self._ends[node] = tuple(found)
        return known

    def _goto(self, node: int, byte: int) -> int:
        """The longest ending of a node's text plus a byte that starts some token."""
        if (to := self._moves.get(node << 8 | byte)) is None:
            text = self.text_of[node] + bytes((byte,))
            while text not in self.node_of:
                text = text[1:]
            to = self._moves[node << 8 | byte] = self.node_of[text]
        return to

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """The transition and its annotation (emitted tokens; a longer token may take some back)."""
        node, past = self.states[state]
        node = self._goto(node, byte)
        for token, length in self._endings(node):
            last, less = past[length - 1]
            if last < 0 or self._fits(last, token):
                emitted = less + 1
                break
        else:
            raise ValueError("no token ends here")
        key = (node, ((token, 0), *((t, c - emitted) for t, c in past[: len(self.text_of[node])])))
        if (to := self.known.get(key)) is None:
            to = self.known[key] = len(self.states)
            self.states.append(key)
        self.table[state << 8 | byte] = (to, emitted)
        return to, emitted

    def _finish(self, state: int, data: bytes) -> int:
        """Runs on from a state without adding to the table, as lazy matchers do when theirs is full."""
        node, past = self.states[state]
        past, pairs = list(past[::-1]), self._pairs
        for byte in data:
            node = self._goto(node, byte)
            for token, length in self._endings(node):
                last, count = past[-length]
                if last < 0 or (pairs[last, token] if (last, token) in pairs else self._fits(last, token)):
                    past.append((token, count + 1))
                    break
        return past[-1][1]

    def tokens(self, piece: str) -> int:
        if piece in self.special:
            return 1
        state, count, table, data = 0, 0, self.table, piece.encode("utf-8")
        for k, byte in enumerate(data):
            hop = table.get(state << 8 | byte)
            if hop is None:
                if len(self.states) >= self.max_states:
                    return count + self._finish(state, data[k:])
                hop = self._step(state, byte)
            state = hop[0]
            count += hop[1]
        return count

    def ids(self, piece: str) -> list[int]:
        """The tokens themselves: the same run, then back from the end."""
        if piece in self.special:
            return [self.special[piece]]
        node, past, data = 0, [-1], piece.encode("utf-8")
        for byte in data:
            node = self._goto(node, byte)
            for token, length in self._endings(node):
                if past[-length] < 0 or self._fits(past[-length], token):
                    past.append(token)
                    break
        out, at = [], len(data)
        while at:
            out.append(past[at])
            at -= len(self.bytes_of[past[at]])
        return out[::-1]

    def counts(self, groups: tuple[list[str], np.ndarray, np.ndarray]) -> np.ndarray:
        """Tokens by text; counts of pieces seen lately are kept, up to max_words."""
        pieces, index, by_text = groups
        each = np.fromiter(map(self.words.__getitem__, pieces), np.int64, len(pieces))
        total = np.concatenate(([0], np.cumsum(each[index])))
        end = np.cumsum(by_text)
        return total[end] - total[end - by_text]


class _Words(dict):
    """Values of short pieces seen lately: `most` at most, of which the older half goes when the newer one is full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, piece: str):
        value = self.older.get(piece)
        if value is None:
            value = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= self.most // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = value
        return value


@lru_cache(maxsize=2)
def compiled(path: str, packed: bytes) -> tuple[Splitter, CountTransducer]:
    """Per Python worker."""
    return Splitter(path, packed), CountTransducer(path)


class Encoder:
    """Ids of texts as the library gives them, special strings included.

    Each pre-token is merged by tiktoken from the same file's vocabulary (its ranks are the merge order, which is
    checked); ids of pieces seen lately are kept, up to max_words.
    """

    def __init__(self, path: str, packed: bytes, max_words: int = 240_000):
        import tiktoken

        spec = _load(path)
        self.splitter = Splitter(path, packed)
        stand_in = byte_alphabet()
        special = self.splitter.special
        ranks = {bytes(stand_in[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        made = [ranks[bytes(stand_in[c] for c in "".join(p.split(" ") if isinstance(p, str) else p))] for p in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError(f"{path}: ids do not follow the merge order")
        merge = tiktoken.Encoding("file", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ranks = ranks
        self.words = _Words(lambda piece: np.array([special[piece]] if piece in special else merge(piece), "<u4").tobytes(), max_words)

    def splitter_vocab(self):
        """(bytes, id) of all tokens."""
        return self.ranks.items()

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids by text)."""
        pieces, index, by_text = self.splitter.groups(texts)
        codes = list(map(self.words.__getitem__, pieces))
        flat, size = np.frombuffer(b"".join(codes), "<u4"), np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        first, each = np.cumsum(size) - size, size[index]
        end = np.cumsum(each)
        where = np.arange(end[-1] if len(end) else 0) + np.repeat(first[index] - end + each, each)
        total, stop = np.concatenate(([0], end)), np.cumsum(by_text)
        return flat[where], total[stop] - total[stop - by_text]


@lru_cache(maxsize=2)
def encoder(path: str, packed: bytes) -> Encoder:
    """Per Python worker."""
    return Encoder(path, packed)
