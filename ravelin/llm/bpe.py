"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of a batch of pre-tokens form one linked list, with a wall between pre-tokens that no pair crosses. Buckets,
one per merge rank, hold the list positions whose pair has that rank; a two-level bitmap over the ranks tells which
buckets hold anything, so the next rank is found by two find-first-set steps whatever the list's length. A merge pushes
the two new pairs and leaves old entries behind; an entry is stale, and skipped, when its position no longer has the
bucket's rank. What array operations push waits by words of the bitmap. Equal ranks go left to right, as in tiktoken.
Pre-tokens don't touch each other, so one queue serves a batch and gives each the ids that it would have alone; a bucket
with many positions is merged by array operations.

Defined cases: a null text encodes as an empty one (no ids, empty bytes); empty texts give no ids; repeated rows give
repeated rows; an empty table gives an empty one; a null doc_id is kept.
"""

from __future__ import annotations

import base64
import hashlib
import string
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import accumulate, chain, compress
from typing import Any

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from ravelin.llm.common import map_chunks, table

#: Entries of each of a worker's two memories, of pre-tokens and of what stands between spaces; a full one loses the half
#: less in use, which changes speed only.
CACHE_ENTRIES = 180_000
#: Pieces of more characters than ``LONG`` go with the next chunk once they have ``LONG_CHARS`` in all.
LONG, LONG_CHARS = 64, 1 << 20
#: Matches of new parts that are looked up at a time, or as many more as one part has.
QUEUE_PIECES = 1 << 18
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


WALL = 65535
#: Positions from which a bucket is merged by array operations.
ARRAY_MERGE = 48


class Merges:
    """Ranks of pairs of tokens. A merged pair's token id is its rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                right = ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 16 | right] = rank
        self.of = found
        # A token some pair of which has a lesser rank than its own: after it, the queue may have to step back.
        self.steps_back = {t for key, rank in found.items() for t in (key >> 16, key & 65535) if rank < t}
        self.of_byte = np.array([ranks[bytes((i,))] for i in range(256)], np.int32)
        self.of_bytes = np.array([found.get(a << 16 | b, -1) for a in self.of_byte.tolist() for b in self.of_byte.tolist()], np.int32)
        keys, merged = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int32, len(found))
        self.after, self.before = (self._by(*x, merged) for x in ((keys >> 16, keys & 65535), (keys & 65535, keys >> 16)))
        self.row = np.full(WALL + 1, -1, np.int32)

    @staticmethod
    def _by(token: np.ndarray, other: np.ndarray, merged: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        order = np.argsort(token, kind="stable")
        return np.searchsorted(token[order], np.arange(WALL + 2)).tolist(), other[order], merged[order]

    def lesser(self, token: int, right: np.ndarray, left: np.ndarray) -> bool:
        """Whether ``token`` makes a pair of a lesser rank than its own with any of these or with itself."""
        found = np.concatenate((self.look_up(token, np.append(right, token), self.after), self.look_up(token, left, self.before)))
        return bool(((found >= 0) & (found < token)).any())

    def look_up(self, token: int, others: np.ndarray, side: tuple[list[int], np.ndarray, np.ndarray]) -> np.ndarray:
        """Ranks of the pairs of ``token`` and each of ``others``, which stand on the ``side`` ``self.after`` or ``self.before``."""
        at, partners, merged = side
        own = slice(at[token], at[token + 1])
        self.row[partners[own]] = merged[own]
        found = self.row[others]
        self.row[partners[own]] = -1
        return found


class RankQueue:
    """List positions by rank: the least rank's bucket comes out whole and in order. Ranks lie in [0, 65536).

    ``top`` has a bit for each word of ``words`` that isn't zero, ``words`` one for each rank whose bucket isn't empty.
    Positions pushed as arrays wait until the queue comes to their word, and are sorted into its buckets then.
    """

    __slots__ = ("top", "words", "buckets", "large", "high", "fresh", "waiting")

    def __init__(self) -> None:
        self.top = 0
        self.words: dict[int, int] = {}
        self.buckets: dict[int, list[int]] = {}
        self.large: dict[int, np.ndarray] = {}  # what a bucket holds besides, if that is much
        self.high = -1  # the word of the last rank that came out
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []  # of words beyond that one
        self.waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def push(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.extend(positions)
            return
        self.buckets[rank] = positions
        self._mark(rank)

    def _mark(self, rank: int) -> None:
        high = rank >> 8
        self.words[high] = self.words.get(high, 0) | 1 << (rank & 255)
        self.top |= 1 << high

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        near = ranks < self.high + 1 << 8
        if near.any():
            buckets = self.buckets
            for x, i in zip(ranks[near].tolist(), positions[near].tolist()):
                if x in buckets:
                    buckets[x].append(i)
                else:
                    self.push(x, [i])
            ranks, positions = ranks[~near], positions[~near]
        if len(ranks):
            self.fresh.append((ranks, positions))

    def _settle(self) -> None:
        """Sorts what is fresh by word."""
        ranks, positions = map(np.concatenate, zip(*self.fresh))
        self.fresh = []
        words = (ranks >> 8).astype(np.uint16)
        order = np.argsort(words, kind="stable")
        ranks, positions, words = ranks[order], positions[order], words[order]
        at = [0, *(np.flatnonzero(words[1:] != words[:-1]) + 1).tolist(), len(words)]
        for a, b in zip(at, at[1:]):
            high = int(words[a])
            self.waiting.setdefault(high, []).append((ranks[a:b], positions[a:b]))
            self.top |= 1 << high

    def _spread(self, high: int) -> None:
        """Sorts what waits for a word into buckets."""
        ranks, positions = map(np.concatenate, zip(*self.waiting.pop(high)))
        order = np.argsort(ranks.astype(np.uint16), kind="stable")
        ranks, positions = ranks[order], positions[order]
        at = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for a, b, rank in zip(at, at[1:], ranks[at[:-1]].tolist()):
            if b - a < ARRAY_MERGE:
                self.push(rank, positions[a:b].tolist())
            else:
                self.large[rank] = np.append(self.large[rank], positions[a:b]) if rank in self.large else positions[a:b]
                self._mark(rank)

    def __bool__(self) -> bool:
        return bool(self.top or self.fresh)

    def pop(self) -> tuple[int, list[int] | np.ndarray]:
        if self.fresh and not self.top & (1 << self.high + 1) - 1:
            self._settle()
        self.high = high = (self.top & -self.top).bit_length() - 1
        if high in self.waiting:
            self._spread(high)
        bits = self.words[high]
        low = bits & -bits
        rank = (high << 8) + low.bit_length() - 1
        if bits == low:
            del self.words[high]
            self.top &= self.top - 1
        else:
            self.words[high] = bits ^ low
        bucket = self.buckets.pop(rank, [])
        if rank in self.large:
            return rank, np.sort(np.append(self.large.pop(rank), np.array(bucket, np.int32)))
        bucket.sort()
        return rank, bucket


def merge(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pre-tokens, one after the other, and their number in each; no pre-token is empty."""
    if not pieces:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.cumsum(lengths + 1) - lengths
    size = int(starts[-1] + lengths[-1]) + 1
    raw = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
    tokens = array("i", merges.of_byte[raw].tobytes())
    token_view = np.frombuffer(tokens, np.int32)
    walls = np.append(starts - 1, size - 1)
    token_view[walls] = WALL
    after, before = array("i", range(1, size + 1)), array("i", range(-1, size - 1))
    after_view, before_view = np.frombuffer(after, np.int32), np.frombuffer(before, np.int32)
    first = np.append(merges.of_bytes[raw[:-1].astype(np.int32) << 8 | raw[1:]], np.int32(-1))
    first[walls] = first[walls - 1] = -1
    current = array("i", first.astype(np.int32).tobytes())
    current_view = np.frombuffer(current, np.int32)
    queue = RankQueue()
    buckets, push, look_up = queue.buckets, queue.push, merges.of.get
    filled = np.flatnonzero(first >= 0).astype(np.int32)
    queue.push_all(first[filled], filled)
    while queue:
        rank, bucket = queue.pop()
        if len(bucket) >= ARRAY_MERGE:
            p = np.asarray(bucket, np.int32)
            p = p[(current_view[p] == rank) & np.append(True, p[1:] != p[:-1])]
            j = after_view[p]
            k = after_view[j]
            if not (j[:-1] == p[1:]).any() and not (rank in merges.steps_back and merges.lesser(rank, token_view[k], token_view[before_view[p]])):
                after_view[p] = k
                before_view[k] = p
                b = before_view[p]
                current_view[j] = -1
                token_view[p] = rank
                current_view[p] = right = merges.look_up(rank, token_view[k], merges.after)
                current_view[b] = left = merges.look_up(rank, token_view[b], merges.before)
                new, where = np.concatenate((right, left)), np.concatenate((p, b))
                kept = new >= 0
                queue.push_all(new[kept], where[kept])
                continue
            bucket = p
        if not isinstance(bucket, list):
            bucket = bucket.tolist()
        for n, i in enumerate(bucket):
            if current[i] != rank:
                continue
            j = after[i]
            k = after[j]
            after[i] = k
            before[k] = i
            current[j] = -1
            tokens[i] = rank
            current[i] = x = look_up(rank << 16 | tokens[k], -1)
            if x >= 0:
                if x in buckets:
                    buckets[x].append(i)
                else:
                    push(x, [i])
            p = before[i]
            current[p] = y = look_up(tokens[p] << 16 | rank, -1)
            if y >= 0:
                if y in buckets:
                    buckets[y].append(p)
                else:
                    push(y, [p])
            if 0 <= x < rank or 0 <= y < rank:
                if rest := bucket[n + 1 :]:
                    push(rank, rest)
                break
    alive = np.zeros(size + 1, bool)
    alive[0] = True
    alive[after_view[before_view[1:size]]] = True  # a position is in the list if its neighbour before leads to it
    alive = alive[:size] & (after_view[np.maximum(before_view, 0)] == np.arange(size)) & (token_view != WALL)
    return token_view[alive], np.add.reduceat(alive.astype(np.int64), starts)


class Memory(dict):
    """Values by key in two generations, which bound its size: what a batch asks for is kept, what none does goes."""

    def __init__(self, entries: int) -> None:
        super().__init__()
        self.entries = entries
        self.old: dict[str, Any] = {}

    def missing(self, keys: set[str]) -> list[str]:
        """Those of ``keys`` that it doesn't have; the others can be looked up from now on, until the next call."""
        if len(self) >= self.entries // 2:
            self.old = dict(self)
            self.clear()
        lacking = keys - self.keys()
        old = self.old
        for key in lacking & old.keys():
            self[key] = old[key]
        return [key for key in lacking if key not in self]


class Known(dict):
    """Numbers of pieces of text met lately, in the order in which they were met; of each its ids and what else is kept in
    ``columns``. Bounded in entries; when full, those most in use stay."""

    def __init__(self, entries: int, columns: int) -> None:
        super().__init__()
        self.entries, self.width = entries, columns
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.ids = np.zeros(0, np.int32)
        self.counts = self.starts = self.uses = np.zeros(0, np.int64)
        self.columns: list[list[Any]] = [[] for _ in range(self.width)]
        self.long = 0

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number

    def numbers(self, keys: Iterable[str], n: int) -> np.ndarray:
        """Numbers of ``n`` pieces; those in ``new`` are to be added."""
        return np.fromiter(map(self.__getitem__, keys), np.int32, n)

    def add(self, ids: np.ndarray, counts: np.ndarray, *columns: list[Any]) -> None:
        """What belongs to the first pieces in ``new``, all of them if ``counts`` has all."""
        self.ids, self.counts = np.append(self.ids, ids), np.append(self.counts, counts)
        self.starts = np.cumsum(self.counts) - self.counts
        self.uses = np.append(self.uses, np.zeros(len(counts), np.int64))
        for all_values, values in zip(self.columns, columns):
            all_values += values
        lengths = np.fromiter(map(len, self.new), np.int64, len(counts))
        self.long += int(lengths[lengths > LONG].sum())
        del self.new[: len(counts)]

    def use(self, numbers: np.ndarray) -> None:
        self.uses += np.bincount(numbers, minlength=len(self.uses))

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these numbers, one after the other."""
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - ends + counts, counts)]

    def make_room(self) -> None:
        """Numbers change, so this is called between chunks. Long pieces, which seldom come again, all go."""
        if len(self) <= self.entries and self.long <= LONG_CHARS:
            return
        keys = list(self)
        kept = np.flatnonzero(np.fromiter(map(len, keys), np.int64, len(keys)) <= LONG)
        most = self.entries // 2
        if len(kept) > most:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[:most]])
        ids, counts, uses = self.gather(kept), self.counts[kept], self.uses[kept] // 2
        keys, *columns = ([x[i] for i in kept.tolist()] for x in (keys, *self.columns))
        self.forget()
        self.update(zip(keys, range(len(keys))))
        self.ids, self.counts, self.starts, self.uses, self.columns = ids, counts, np.cumsum(counts) - counts, uses, columns


class Encoded:
    """A text as numbers of matches and, after these, of parts that an encoder knows; valid until its next chunk."""

    __slots__ = ("own", "matches", "parts")

    def __init__(self, own: Encoder, matches: np.ndarray, parts: np.ndarray) -> None:
        self.own, self.matches, self.parts = own, matches, parts

    def __len__(self) -> int:
        return int(self.own.of_match.counts[self.matches].sum() + self.own.of_part.counts[self.parts].sum())

    def ids(self) -> np.ndarray:
        return np.append(self.own.of_match.gather(self.matches), self.own.of_part.gather(self.parts))

    def _joined(self, of_id: list[Any], of_part: list[Any], by: Any) -> Any:
        return by.join([*map(of_id.__getitem__, self.own.of_match.gather(self.matches).tolist()), *map(of_part.__getitem__, self.parts.tolist())])

    def decimals(self) -> str:
        """The ids as decimals, joined by commas; those of equal parts have been joined once."""
        return self._joined(self.own.decimal_of, self.own.of_part.columns[0], ",")

    def decoded(self) -> bytes:
        """What the ids decode to; those of equal parts have been decoded once."""
        return self._joined(self.own.bytes_of, self.own.of_part.columns[1], b"")


class Encoder:
    """Encodes by a rank file's ranks.

    A space that no white space follows begins a match of the pattern, so a text in which every space is of that kind is
    cut there, and each part is looked up with its space. Any other text is matched whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.merges = Merges(ranks)
        self.matches = regex.compile(pattern).findall
        self.spaces_differ = regex.compile(r" (?:\s|$)").search if pattern == _public_pattern() else lambda text: True
        size = max(ranks.values()) + 1
        self.bytes_of = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.decimal_of = [str(i) for i in range(size)]
        self.digits = np.array([*map(len, self.decimal_of)])
        self.lengths = np.array([*map(len, self.bytes_of)])
        self.of_match = Known(CACHE_ENTRIES, 0)
        self.of_part = Known(CACHE_ENTRIES, 2)

    def chunk(self, texts: list[str]) -> list[Encoded]:
        """Encodes texts; asks the queue once for all pre-tokens not met lately."""
        of_match, of_part = self.of_match, self.of_part
        of_match.make_room()
        of_part.make_room()
        heads, parts = [], []
        for text in texts:
            if self.spaces_differ(text):
                heads.append([x for x in self.matches(text) if x])
                parts.append([])
            else:
                head, *rest = text.split(" ")
                heads.append(self.matches(head))
                parts.append(rest)
        head_ends, part_ends = ([*accumulate(map(len, x))] for x in (heads, parts))
        if not texts:
            return []
        of_heads = of_match.numbers(chain.from_iterable(heads), head_ends[-1])
        of_parts = of_part.numbers(chain.from_iterable(parts), part_ends[-1])
        del heads, parts
        self._learn()
        of_match.use(of_heads)
        of_part.use(of_parts)
        return [
            Encoded(self, of_heads[a:b], of_parts[c:d])
            for a, b, c, d in zip([0, *head_ends], head_ends, [0, *part_ends], part_ends)
        ]

    def _learn(self) -> None:
        """Encodes the new parts and matches, so many at a time that their strings take little memory."""
        own: list[str] = []
        n: list[int] = []
        for part in [*self.of_part.new]:
            if len(own) >= QUEUE_PIECES:
                self._add(own, n)
                n.clear()
            stem = part.rstrip(string.punctuation)
            if not stem.isalpha():
                found = self.matches(" " + part)
                own += found
                n.append(len(found))
            elif len(stem) == len(part):
                own.append(" " + part)
                n.append(1)
            else:
                own += (" " + stem, part[len(stem) :])
                n.append(2)
        self._add(own, n)

    def _add(self, own: list[str], n: list[int]) -> None:
        """The next ``len(n)`` of the new parts have these matches, as many each as ``n`` tells."""
        of_match, of_part = self.of_match, self.of_part
        numbers = of_match.numbers(own, len(own))
        own.clear()  # those that are known already take memory no longer
        raws = [x.encode("utf-8") for x in of_match.new]
        whole = np.fromiter((self.ranks.get(x, -1) for x in raws), np.int32, len(raws))
        known = whole >= 0
        merged, several = merge([*compress(raws, (~known).tolist())], self.merges)
        # A pre-token that is a token has its rank as its one id, put in place among those of the others.
        counts = np.ones(len(whole), np.int64)
        counts[~known] = several
        ids = np.empty(int(counts.sum()), np.int32)
        single = np.zeros(len(ids), bool)
        single[(np.cumsum(counts) - counts)[known]] = True
        ids[single] = whole[known]
        ids[~single] = merged
        of_match.add(ids, counts)
        of_match.use(numbers)
        ids = of_match.gather(numbers)
        counts = np.add.reduceat(of_match.counts[numbers], np.cumsum(n) - n) if n else np.zeros(0, np.int64)
        # All decimals and bytes in one, cut where parts end.
        listed, last = ids.tolist(), np.cumsum(counts) - 1
        decimals, decoded = ",".join(map(self.decimal_of.__getitem__, listed)), b"".join(map(self.bytes_of.__getitem__, listed))
        ends, raw_ends = (np.cumsum(self.digits[ids] + 1)[last] - 1).tolist(), np.cumsum(self.lengths[ids])[last].tolist()
        of_part.add(
            ids,
            counts,
            [decimals[a:b] for a, b in zip([0, *(x + 1 for x in ends)], ends)],
            [decoded[a:b] for a, b in zip([0, *raw_ends], raw_ends)],
        )

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids().tolist() for x in self.chunk(texts)]

    def forget(self) -> None:
        self.of_match.forget()
        self.of_part.forget()


def _public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One a worker process; the rank file must be on every machine, as the tokenizer package is."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Encoder(ranks, pattern)


def _ids_and_bytes(text: Encoded) -> tuple[Any, ...]:
    return len(text), text.ids(), text.decoded()


def _digests(text: Encoded) -> tuple[Any, ...]:
    return len(text), hashlib.sha256(text.decimals().encode()).hexdigest(), hashlib.sha256(text.decoded()).hexdigest()


def ids_and_digests(text: Encoded) -> tuple[Any, ...]:
    n, *digests = _digests(text)
    return n, text.ids(), *digests


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    pattern: str | None = None,
    emit: Callable[[Encoded], tuple[Any, ...]] = _ids_and_bytes,
    emitted: str = "n_tokens long, ids array<int>, decoded binary",
) -> DataFrame:
    """Each document's token ids and the bytes they decode to, or what ``emit`` makes of them.

    ``vocabulary`` is a rank file's name in the tokenizer package, or a path. One narrow pass: no shuffle, and a
    worker holds the ids of one chunk of documents at a time.
    """

    def start() -> Callable[..., Iterable[tuple[Any, ...]]]:
        import public_tokenizers

        own = encoder(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), pattern or public_tokenizers.PATTERN)

        def each(keys: list[Any], texts: list[str | None]) -> Iterable[tuple[Any, ...]]:
            return [(k, *emit(x)) for k, x in zip(keys, own.chunk([t or "" for t in texts]))]

        each.close = own.forget  # type: ignore[attr-defined]
        return each

    kind = docs.schema[id_col].dataType.simpleString()
    return map_chunks(docs, [id_col, text_col], start, f"{id_col} {kind}, {emitted}")


def digests(docs: DataFrame) -> DataFrame:
    return encode(docs, emit=_digests, emitted="n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op3_bpe": op3_bpe}
ORACLES: dict[str, str] = {}
