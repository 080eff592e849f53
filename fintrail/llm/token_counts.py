"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from fintrail.llm.common import slices, text_bytes

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512                    # tokens over which a text is marked
PIECE = 1 << 20                # bytes of text that one step holds (a longer text goes through in parts)
STEP = 200_000                 # parts of a longer text that one step holds
LONG = 512                     # bytes from which a part is merged by itself
REMEMBERED = 300_000           # parts whose counts a worker remembers; it starts afresh beyond them
NEVER = np.int32(2**31 - 1)
# fixed value: how a text is cut into parts before bytes are merged
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# fixed values: code points that are letters or numbers only in newer Unicode tables than the vocabulary's own library has
LATE = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    r"\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f")
LATE_BYTE = 0xD5               # no UTF-8 text without bytes from here on holds any of them
_LATE = regex.compile(f"[{LATE}]")
_PARTS = regex.compile(PARTS)
_PARTS_LATE = regex.compile(
    PARTS.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{LATE}]]").replace(r" ?\p{L}", rf" ?[\p{{L}}--[{LATE}]]")
    .replace(r" ?\p{N}", rf" ?[\p{{N}}--[{LATE}]]"), regex.V1)


def byte_names() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if it is visible Latin-1, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges:
    """Ranked pairs of symbols. `counts` gives how many symbols are left of each byte string when no pair is left.

    Pairs are merged in the order of their rank. A pair that uses a symbol must rank behind every pair that makes it;
    then merging all places of a string's lowest pair at once leaves what merging them one by one does.
    """

    def __init__(self, pairs: list[tuple[str, str]], special: Iterable[str] = ()):
        names = byte_names()
        ids = {n: i for i, n in enumerate(names)}
        made: dict[int, int] = {}
        keys, new = [], []
        for rank, (a, b) in enumerate(pairs):
            if a not in ids or b not in ids:
                raise ValueError(f"pair {rank} uses a symbol that no earlier pair makes: {a!r} {b!r}")
            to = ids.setdefault(a + b, len(ids))
            keys.append(ids[a] << 32 | ids[b])
            new.append(to)
            made[to] = rank
        for rank, key in enumerate(keys):
            if max(made.get(key >> 32, -1), made.get(key & 0xFFFFFFFF, -1)) >= rank:
                raise ValueError(f"pair {rank} ranks before a pair that makes one of its symbols")
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(2**63 - 1))
        self.ranks = np.append(order.astype(np.int32), NEVER)
        self.new = np.array(new, np.int32)
        self.special = sorted({s for s in special if s}, key=lambda s: (-len(s), s))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def counts(self, parts: list[bytes]) -> list[int]:
        out = np.array([len(p) for p in parts], np.int64)
        todo = np.flatnonzero((out > 1) & (out < LONG))
        if len(todo):
            out[todo] = self._together([parts[i] for i in todo])
        for i in np.flatnonzero(out >= LONG):
            out[i] = self._alone(parts[i])
        return out.tolist()

    def _together(self, parts: list[bytes]) -> np.ndarray:
        """All parts in one ragged array; each round applies the lowest pair of every part that still has one."""
        sym = np.frombuffer(b"".join(parts), np.uint8).astype(np.int32)
        size = np.array([len(p) for p in parts], np.int64)
        left = size.copy()
        who = np.arange(len(parts))
        rank = np.full(len(sym), NEVER, np.int32)      # of the pair that starts here
        rank[:-1] = self.rank(sym[:-1], sym[1:])
        rank[np.cumsum(size) - 1] = NEVER
        while len(size):
            starts = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, starts)
            live = least != NEVER
            if not live.all():
                left[who[~live]] = size[~live]
                keep = np.repeat(live, size)
                sym, rank = sym[keep], rank[keep]
                who, size, least = who[live], size[live], least[live]
                if not len(size):
                    break
            hit = _apart(np.flatnonzero(rank == np.repeat(least, size)))
            sym[hit] = self.new[rank[hit]]
            gone = np.zeros(len(sym), bool)
            gone[hit + 1] = True
            size = size - np.add.reduceat(gone, np.cumsum(size) - size, dtype=np.int64)
            here = hit - np.arange(len(hit))           # places of the merged symbols once the others are gone
            sym, rank = sym[~gone], rank[~gone]
            rank[here] = NEVER
            near = here[here < len(sym) - 1]
            rank[near] = self.rank(sym[near], sym[near + 1])
            near = here[here > 0] - 1
            rank[near] = self.rank(sym[near], sym[near + 1])
            rank[np.cumsum(size) - 1] = NEVER
        return left

    def _alone(self, part: bytes) -> int:
        """One long part as a linked list; places wait under their pair's rank, and each rank's places are merged at once."""
        sym = np.frombuffer(part, np.uint8).astype(np.int32)
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, NEVER, np.int32)
        rank[:-1] = self.rank(sym[:-1], sym[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[rank[at] != NEVER]
            at = at[np.argsort(rank[at], kind="stable")]
            for group in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else ():
                r = int(rank[group[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(group)
        put(np.arange(n))
        count = n
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]                     # places that have changed since they were put here drop out
            at = _apart(at, after)
            if not len(at):
                continue
            second = after[at]
            sym[at] = self.new[r]
            rank[second] = NEVER
            after[at] = after[second]
            follow = after[at]
            before[follow[follow < n]] = at[follow < n]
            count -= len(at)
            rank[at] = NEVER
            ahead = before[at]
            near = np.unique(np.concatenate([at, ahead[ahead >= 0]]))
            near = near[after[near] < n]
            rank[near] = self.rank(sym[near], sym[after[near]])
            put(near)
        return count


def _apart(hit: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Of places in a row that overlap (a pair of two like symbols), every other one from the first on."""
    if len(hit) < 2:
        return hit
    joined = np.zeros(len(hit), bool)
    joined[1:] = hit[1:] == (hit[:-1] + 1 if after is None else after[hit[:-1]])
    if not joined.any():
        return hit
    no = np.arange(len(hit))
    first = np.maximum.accumulate(np.where(joined, 0, no))
    return hit[(no - first) % 2 == 0]


def load(path: str | None = None) -> Merges:
    """Reads a byte-level BPE vocabulary file (by default the public one named VOCABULARY) on the driver."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return Merges(pairs, [t["content"] for t in spec.get("added_tokens", [])])


def _sections(text: str, special: "regex.Pattern | None") -> tuple[list[str], int]:
    """The text between special strings, and how many of them it holds."""
    if special is None:
        return [text], 0
    cut = special.split(text)
    return cut, len(cut) - 1


def count_batches(batches: Iterator[pa.RecordBatch], merges: Merges, limit: int) -> Iterator[pa.RecordBatch]:
    special = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None
    known: dict[str, int] = {}

    def learn(parts: set[str]) -> None:
        if len(known) > REMEMBERED:
            known.clear()
            parts = set(parts)
        new = [p for p in parts if p not in known]
        known.update(zip(new, merges.counts([p.encode() for p in new])))

    def pattern(text: str) -> "regex.Pattern":
        return _PARTS_LATE if late and _LATE.search(text) else _PARTS

    def long_text(text: str) -> int:
        cut, total = _sections(text, special)
        for s in cut:
            found = (m.group() for m in pattern(s).finditer(s))
            while some := list(islice(found, STEP)):
                learn(set(some))
                total += sum(map(known.__getitem__, some))
        return total

    for b in slices(batches, "text", PIECE):
        texts = [t or "" for t in b.column("text").to_pylist()]
        n_bytes = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
        late = text_bytes(b.column("text"))[0].max(initial=0) >= LATE_BYTE
        if len(texts) == 1 and n_bytes[0].as_py() > PIECE:
            counts = [long_text(texts[0])]
        else:
            parts, extra = [], []
            for t in texts:
                cut, n = _sections(t, special)
                parts.append([p for s in cut for p in pattern(s).findall(s)] if n else pattern(t).findall(t))
                extra.append(n)
            learn(set().union(*parts))
            counts = [n + sum(map(known.__getitem__, p)) for n, p in zip(extra, parts)]
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), n_bytes, pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
            names=["id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of every text, one row for each row of `docs`: id_col, n_bytes, n_tokens, over_limit.

    A text is cut at special strings (one token each, as the vocabulary's library counts them by default), then into
    parts by PARTS; each different part of an Arrow slice is merged once. No row moves between tasks.

    Nulls: a null text counts as empty (0, 0, false); a null id stays. Empty texts have no tokens. Very long texts are
    gone through in parts of STEP at a time, a very long part (a run without blanks) is merged as a linked list; nothing
    is cut off. Ties: places of equal rank are merged from the left. Repeated rows give repeated rows, an empty table
    no row. Other columns are not read, so none can clash.
    """
    merges = load(path)
    d = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    return (d.mapInArrow(lambda batches: count_batches(batches, merges, limit),
                         f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
            .withColumnRenamed("id", id_col))
