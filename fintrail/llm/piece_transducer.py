"""SentencePiece encoding and decoding as shortest paths through a weighted finite-state transducer."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from fintrail.llm.common import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"               # fixed value: what the normaliser writes for a space
PATHS_KEPT, PAIRS_KEPT = 400_000, 600_000   # bounds of what a worker remembers; it starts afresh beyond them
PIECE = 1 << 20
LONG = 64                  # parts of more characters are composed alone and not remembered
NONE = -2
STEP = 1 << 20             # tokens whose bytes are gathered at once
INF = math.inf


def _fields(raw: bytes) -> Iterable[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message (integers and byte strings)."""
    at = 0

    def varint():
        nonlocal at
        shift = value = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value
    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, raw[at:at + n]
            at += n
        else:
            n = 4 if tag & 7 == 5 else 8
            yield tag >> 3, raw[at:at + n]
            at += n


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of the runs [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Automaton:
    """Deterministic automaton of the pieces' characters, as a hash table from (state, character) to state.

    State 0 is the beginning; `piece` gives the piece that ends in a state, or -1. All moves of an array of states are
    made at once.
    """

    def __init__(self, states: dict[str, int]):
        number = {"": 0} | {p: i for i, p in enumerate(states, 1)}
        self.piece = np.array([-1, *states.values()], np.int32)
        keys = np.array([number[p[:-1]] << 21 | ord(p[-1]) for p in states], np.int64)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        places = self._place(keys)
        for key, place, state in zip(keys.tolist(), places.tolist(), range(1, len(keys) + 1)):
            while self.keys[place] >= 0:
                place = place + 1 & (1 << self.bits) - 1
            self.keys[place], self.to[place] = key, state

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def move(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        keys = states.astype(np.int64) << 21 | chars
        place = self._place(keys)
        found = self.keys[place]
        out = np.where(found == keys, self.to[place], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            place[open_] = place[open_] + 1 & (1 << self.bits) - 1
            found = self.keys[place[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.to[place[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Transducer:
    """Normaliser, pieces and byte fallback, compiled; `encode` composes them with a text and takes the best path.

    Normaliser: an optional prefix and one output string for each input string in `rules` (the longest input wins);
    other characters stand for themselves. Pieces: an arc for each piece, weighted in the tropical semiring. A
    character that no piece covers has one path, its bytes. For a unigram model an arc weighs minus its score. For a
    BPE model a piece weighs nothing, and following another piece weighs nothing or infinity: nothing if merging the
    two pieces' characters by rank gives these two pieces again. A sequence in which this holds for all neighbours is
    the one that the merges make of the whole text, so exactly one path is finite.
    """

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], skipped: set[int],
                 bpe: bool, unknown: int = 0, prefix: bool = True, rules: dict[str, str] | None = None):
        usable = {p: i for i, p in enumerate(pieces) if i not in skipped and i not in set(byte_ids.values())}
        self.pieces, self.scores, self.ids, self.bytes, self.bpe = pieces, scores, usable, byte_ids, bpe
        self.unknown, self.prefix = unknown, prefix
        self.rules = {" ": SPACE} | (rules or {})
        self.least = min((scores[i] for i in usable.values()), default=0.0) - 10
        # prefixes of pieces: the states of the piece automaton
        self.states = {p[:k]: -1 for p in usable for k in range(1, len(p))} | usable
        # parts that no piece reaches across: their best paths follow each other
        soft = {c for p in usable if len(p) > 1 for c in p} - {SPACE}
        joined = {p[k:k + 2] for p in usable for k in range(len(p) - 1)}
        letters = {c for c in soft if c.isalpha()}
        closing = {c for c in soft - letters} - {j[1] for j in joined if j[0] in letters}
        group = lambda x: f"[{''.join(re.escape(c) for c in sorted(x))}]" if x else r"(?!)"
        some, some_letters = group(soft), group(letters)
        inner = any(j[0] != SPACE and j[1] == SPACE for j in joined)
        self.parts = re.compile(r"[\s\S]+" if inner else
                                f"{SPACE}*{some_letters}+(?={group(closing)})|{SPACE}+{some}*|{some}+|[\\s\\S]")
        self.rewrite = re.compile("|".join(map(re.escape, sorted(self.rules, key=len, reverse=True))))
        self.plain = set(self.rules) == {" "}
        self.out = [p.replace(SPACE, " ").encode() for p in pieces]
        for value, i in byte_ids.items():
            self.out[i] = bytes([value])
        for i in skipped:
            self.out[i] = b""
        self.out[unknown] = " ⁇ ".encode()
        self.out_length = np.array([len(x) for x in self.out], np.int64)
        self.out_start = np.cumsum(self.out_length) - self.out_length
        self.out_bytes = np.frombuffer(b"".join(self.out), np.uint8)
        self.automaton = Automaton(self.states)
        self._pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        """Known parts by number, and their ids: part k has length[k] ids from start[k] on."""
        self._known: dict[str, int] = {}
        self._tokens, self._start, self._length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        text = text.replace(" ", SPACE) if self.plain else self.rewrite.sub(lambda m: self.rules[m.group()], text)
        return SPACE + text if self.prefix else text

    def _merged(self, text: str) -> list[str]:
        """What merging neighbours by rank makes of a few characters: the weights of the BPE arcs rest on it."""
        s, get, scores = list(text), self.ids.get, self.scores
        while len(s) > 1:
            best, at = -INF, -1
            for i in range(len(s) - 1):
                p = get(s[i] + s[i + 1])
                if p is not None and scores[p] > best:
                    best, at = scores[p], i
            if at < 0:
                break
            s[at:at + 2] = [s[at] + s[at + 1]]
        return s

    def _follows(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a (-1: the beginning of a part)."""
        key = (a + 1) << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS_KEPT:
                self._pairs.clear()
            right = self.pieces[b]
            if a < 0 or a == self.unknown:
                known = self._merged(right) == [right]
            else:
                left = self.pieces[a]
                known = self._merged(left + right) == [left, right]
            self._pairs[key] = known
        return known

    def _spelled(self, c: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in c.encode()) if self.bytes else (self.unknown,)

    def _bpe_path(self, part: str) -> tuple[int, ...]:
        """The one path of finite weight through a part: each position has one arc that may end there."""
        n, states, pairs, rank = len(part), self.states, self._pairs, -1
        arc, back = [None] * (n + 1), [0] * (n + 1)
        for i in range(n):
            if i:
                rank = arc[i]
                if rank is None:
                    continue
            for j in range(i + 1, n + 1):
                p = states.get(part[i:j])
                if p is None:
                    break
                if p >= 0 and arc[j] is None:
                    known = pairs.get((rank + 1) << 32 | p)
                    if known if known is not None else self._follows(rank, p):
                        arc[j], back[j] = p, i
            if arc[i + 1] is None and part[i] not in self.ids:
                arc[i + 1], back[i + 1] = self.unknown, i    # stands for the character's bytes
        out, at = [], n
        while at:
            if arc[at] == self.unknown:
                out.extend(reversed(self._spelled(part[back[at]])))
            else:
                out.append(arc[at])
            at = back[at]
        return tuple(reversed(out))

    def _unigram_path(self, part: str) -> tuple[int, ...]:
        """The path of least weight through a part, by position."""
        n, states = len(part), self.states
        cost, arc, back = [0.0] + [INF] * n, [()] * (n + 1), [0] * (n + 1)
        for i in range(n):
            for j in range(i + 1, n + 1):
                p = states.get(part[i:j])
                if p is None:
                    break
                if p >= 0 and cost[i] - self.scores[p] < cost[j]:
                    cost[j], arc[j], back[j] = cost[i] - self.scores[p], (p,), i
            if part[i] not in self.ids and cost[i] - self.least < cost[i + 1]:
                cost[i + 1], arc[i + 1], back[i + 1] = cost[i] - self.least, self._spelled(part[i]), i
        out, at = [], n
        while at:
            out.append(arc[at])
            at = back[at]
        return tuple(chain.from_iterable(reversed(out)))

    def _bpe_paths(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The paths of many short parts, all composed at the same time: ids one after the other, and ids per part."""
        n = np.array([len(p) for p in parts], np.int64)
        order = np.argsort(-n, kind="stable")
        chars = np.frombuffer("".join([parts[k] for k in order.tolist()]).encode("utf-32-le"), np.uint32).astype(np.int64)
        n = n[order]
        first = np.cumsum(n) - n
        base = first + np.arange(len(n))           # place 0 of each part among the places between characters
        arc, back = np.full(len(chars) + len(n), NONE, np.int64), np.zeros(len(chars) + len(n), np.int64)
        arc[base] = -1
        pairs, follows = self._pairs, self._follows
        for i in range(int(n[0])):
            some = np.arange(np.searchsorted(-n, -i, side="left"))         # parts with a character at i
            rows = some[arc[base[some] + i] != NONE]
            left, state = arc[base[rows] + i], np.zeros(len(rows), np.int32)
            for j in range(i + 1, int(n[0]) + 1):
                state = self.automaton.move(state, chars[first[rows] + j - 1])
                piece = np.where(state >= 0, self.automaton.piece[state], -1)
                if j == i + 1:
                    bare = base[rows[piece < 0]] + j                       # no piece covers the character alone
                    bare = bare[arc[bare] == NONE]
                    arc[bare], back[bare] = self.unknown, i
                ends = base[rows] + j
                may = np.flatnonzero((piece >= 0) & (arc[ends] == NONE))
                if len(may):
                    l, p = left[may], piece[may].astype(np.int64)
                    known = [k if k is not None else follows(a, b) for k, a, b in
                             zip(map(pairs.get, (l + 1 << 32 | p).tolist()), l.tolist(), p.tolist())]
                    may = may[np.array(known, bool)]
                    arc[ends[may]], back[ends[may]] = piece[may], i
                on = np.flatnonzero((state >= 0) & (n[rows] > j))
                if not len(on):
                    break
                rows, left, state = rows[on], left[on], state[on]
        used = np.zeros(len(arc), bool)
        rows, at = np.arange(len(n)), n.copy()
        while len(rows):
            here = base[rows] + at[rows]
            used[here] = True
            at[rows] = back[here]
            rows = rows[at[rows] > 0]
        at = np.flatnonzero(used)
        owner = np.searchsorted(base, at, side="right") - 1
        ids, counts = arc[at], np.ones(len(at), np.int64)
        bare = np.flatnonzero(ids == self.unknown)
        spelled = [self._spelled(chr(x)) for x in chars[at[bare] - owner[bare] - 1].tolist()]
        counts[bare] = [len(x) for x in spelled]
        flat = np.repeat(ids, counts)
        flat[_spread((np.cumsum(counts) - counts)[bare], counts[bare])] = list(chain.from_iterable(spelled))
        per = np.bincount(owner, counts, len(n)).astype(np.int64)
        start, place = np.cumsum(per) - per, np.empty_like(order)
        place[order] = np.arange(len(order))
        return flat[_spread(start[place], per[place])].astype(np.int32), per[place]

    def _learn(self, parts: list[str], tokens: np.ndarray, lengths: np.ndarray) -> None:
        self._known.update(zip(parts, range(len(self._length), len(self._length) + len(parts))))
        self._start = np.concatenate([self._start, len(self._tokens) + np.cumsum(lengths) - lengths])
        self._tokens, self._length = np.concatenate([self._tokens, tokens]), np.concatenate([self._length, lengths])

    def encode_all(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after the other, and where each text's ids begin and end."""
        if len(self._known) >= PATHS_KEPT:
            self._forget()
        split = [self.parts.findall(self.normalise(x)) if x else [] for x in texts]
        new = [p for p in dict.fromkeys(chain.from_iterable(split)) if p not in self._known]
        short = [p for p in new if len(p) <= LONG] if self.bpe else []
        alone = [p for p in new if len(p) > LONG] if self.bpe else new
        if short:
            self._learn(short, *self._bpe_paths(short))
        parts_known, tokens_known = len(self._length), len(self._tokens)
        if alone:
            paths = [self._bpe_path(p) if self.bpe else self._unigram_path(p) for p in alone]
            sizes = np.array([len(p) for p in paths], np.int64)
            self._learn(alone, np.fromiter(chain.from_iterable(paths), np.int32, sizes.sum()), sizes)
        sizes = np.array([len(x) for x in split], np.int64)
        part = np.fromiter(map(self._known.__getitem__, chain.from_iterable(split)), np.int64, sizes.sum())
        lengths = self._length[part]
        flat = self._tokens[_spread(self._start[part], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        offsets = total[np.concatenate([[0], np.cumsum(sizes)])]
        if any(len(p) > LONG for p in alone):      # long parts are not kept
            for p in alone:
                del self._known[p]
            self._start, self._length = self._start[:parts_known], self._length[:parts_known]
            self._tokens = self._tokens[:tokens_known]
        return flat, offsets

    def decode_all(self, flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The inverse paths: pieces and bytes back to texts, less the prefix. Bytes that are no UTF-8 become U+FFFD."""
        if len(flat) and (flat.min() < 0 or flat.max() >= len(self.out)):
            raise ValueError("an id is not one of the model's")
        lengths = self.out_length[flat]
        data = np.concatenate([np.empty(0, np.uint8)] + [
            self.out_bytes[_spread(self.out_start[flat[k:k + STEP]], lengths[k:k + STEP])] for k in range(0, len(flat), STEP)])
        at = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        if self.prefix:
            full = np.flatnonzero(at[1:] > at[:-1])
            cut = full[data[at[full]] == 32]
            data = np.delete(data, at[cut])
            at = at - np.concatenate([[0], np.cumsum(np.isin(np.arange(len(at) - 1), cut))])
        raw = data.tobytes()
        try:
            raw.decode()
            inner = at[(at > 0) & (at < len(data))]
            whole = not np.any(data[inner] & 0xC0 == 0x80)
        except UnicodeDecodeError:
            whole = False
        if whole:
            kind, width = (pa.string(), np.int32) if len(raw) < 1 << 31 else (pa.large_string(), np.int64)
            return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at.astype(width).tobytes()), pa.py_buffer(raw)])
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        ids = np.array(list(ids), np.int64)
        return self.decode_all(ids, np.array([0, len(ids)]))[0].as_py()


def load(model: str = MODEL) -> Transducer:
    """Compiles a SentencePiece model file with an identity normaliser (BPE or unigram, with or without bytes)."""
    with open(model, "rb") as f:
        raw = f.read()
    pieces, scores, byte_ids, skipped, unknown = [], [], {}, set(), 0
    kind, prefix, chars_map, squeeze = 1, True, b"", True
    for field, value in _fields(raw):
        if field == 1:
            piece = dict(_fields(value))
            text, sort, no = piece[1].decode(), piece.get(3, 1), len(pieces)
            pieces.append(text)
            scores.append(float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]))
            if sort == 6:
                byte_ids[int(text[3:5], 16)] = no
            elif sort in (2, 3, 5):
                skipped.add(no)
                unknown = no if sort == 2 else unknown
        elif field == 2:
            kind = dict(_fields(value)).get(3, 1)
        elif field == 3:
            spec = dict(_fields(value))
            prefix, chars_map, squeeze = bool(spec.get(3, 1)), spec.get(2, b""), bool(spec.get(4, 1))
    if kind not in (1, 2) or chars_map or squeeze:
        raise ValueError("only unigram and BPE models with an identity normaliser can be compiled")
    return Transducer(pieces, scores, byte_ids, skipped, kind == 2, unknown, prefix)


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """Per document: id, token_ids, n_tokens, and with `check` decoded (the ids decoded again) and whether that is the text.

    The model is read and compiled by the driver and sent to the tasks, a few megabytes whatever the data. Null and
    empty texts have no tokens and decode to empty text. Every other text decodes to itself, but for U+2581, which
    becomes a space, as it stands for one in the pieces. Control pieces are never produced: their strings in a text
    are ordinary text. Repeated rows are encoded alike; other columns are left out.
    """
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches):
        t = shared.value
        for b in slices(batches, limit=PIECE):
            flat, offsets = t.encode_all(b.column("text").to_pylist())
            columns = [b.column("id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.array(np.diff(offsets))]
            names = ["id", "token_ids", "n_tokens"]
            if check:
                decoded = t.decode_all(flat, offsets)
                columns += [decoded, pc.equal(decoded, pc.fill_null(b.column("text"), ""))]
                names += ["decoded", "exact"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInArrow(run, f"id {kind}, token_ids array<int>, n_tokens long" + (", decoded string, exact boolean" if check else ""))


def decode(tokens: DataFrame, model: str = MODEL, id_col: str = "id", tokens_col: str = "token_ids") -> DataFrame:
    """Per row: id and text. Null ids of a row decode to null; ids outside the model are an error."""
    kind = dict(tokens.dtypes)[id_col]
    shared = tokens.sparkSession.sparkContext.broadcast(load(model))

    def run(batches):
        t = shared.value
        for b in batches:
            rows = b.column("ids")
            lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = np.asarray(pc.list_flatten(rows).to_numpy(zero_copy_only=False))
            texts = t.decode_all(ids.astype(np.int64), np.concatenate([[0], np.cumsum(lengths)]))
            texts = pc.if_else(pc.is_null(rows), pa.scalar(None, texts.type), texts)
            yield pa.RecordBatch.from_arrays([b.column("id"), texts], names=["id", "text"])

    slim = tokens.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{tokens_col}`").alias("ids"))
    return slim.mapInArrow(run, f"id {kind}, text string")
