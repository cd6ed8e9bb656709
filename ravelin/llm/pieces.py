"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The words of a batch that aren't remembered lie side by side in flat numpy arrays, a symbol a place. In a round every
segment takes the least rank among its neighbouring pairs (a segmented minimum), merges all its pairs of that rank at once,
from the left where they overlap, and the arrays are compacted; segments without a pair leave, until none is left. Pieces
rank by score, the best first.

The model applies the pair of the best score next, the leftmost among equals, over the whole text. Rounds give the same:

- no piece spans two neighbouring characters that occur side by side in no piece, so a text falls into segments there that
  never bear on each other; words are cut before each run of marks (U+2581, a blank) for the same reason, if no piece has a
  mark after another character (else a text is one word);
- merging all pairs of one rank at once equals merging them one by one if a merge makes no new pair of that rank or a better
  one. Pieces for which it may do so (``steps_back``) are merged one at a time in a segment: what such a merge sets off is one
  growing piece, so pairs further apart than two of the longest pieces don't bear on each other, and each goes at once;
- runs of blanks are all of one rank, so they would take as many rounds as there are blanks. They are merged from the left,
  and when the longest piece of blanks is made, nothing can be added to it; where that holds, which is tried out when a model
  is read, a long run is cut into such pieces and a rest.

A character that is in no piece becomes its bytes' pieces. Ids decode to their pieces with marks as blanks, the first mark
left out; pieces of bytes form characters, or U+FFFD for a byte that is part of none; begin, end and other control ids are
nothing, an unknown id is `` ⁇ ``.

Defined cases: a null text encodes as an empty one, which has the begin and end ids only; a mark in a text is a blank, so it
comes back as one; repeated rows give repeated rows; an empty table gives an empty one; a null doc_id is kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ravelin.llm.bpe import Memory
from ravelin.llm.common import map_chunks, table

VOCABULARY = "piece_bpe_32k.model"
#: Entries of a worker's memory of encoded words; what isn't asked for goes, which changes speed only.
CACHE_ENTRIES = 250_000
MARK = "▁"
_RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
#: What is looked at for blanks to cut.
LONG_RUN = 3 * MARK
NONE = np.int32(2**31 - 1)


class Pairs:
    """A map from pairs of numbers under 2^31 to numbers, -1 for others, by a sorted array."""

    def __init__(self, known: dict[tuple[int, int], int]) -> None:
        keys = np.array([a << 32 | b for a, b in known], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**63 - 1))
        self.values = np.append(np.array(list(known.values()), np.int32)[order], np.int32(-1))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.values[at], np.int32(-1))


class Model:
    """``pieces`` maps mergeable pieces to (id, score); ``bytes_of`` are the ids of the 256 bytes; ``text_of`` has each id's
    UTF-8, None for pieces of bytes."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_of: list[int], text_of: list[bytes | None], begin: int, end: int) -> None:
        self.bytes_of, self.text_of, self.begin, self.end = bytes_of, text_of, begin, end
        ids = {piece: n for piece, (n, _) in pieces.items()}
        for c in sorted(set("".join(pieces)) - ids.keys()):  # characters that occur in pieces only
            ids[c] = len(text_of) + len(ids)
        self.most = max(map(len, pieces), default=1)
        by_score = sorted({s for _, s in pieces.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(by_score)}
        size = max(ids.values(), default=0) + 1
        self.rank_of = np.full(size + 1, NONE, np.int32)  # last for no piece, which is -1
        for n, s in pieces.values():
            self.rank_of[n] = rank[s]
        found = {(ids[p[:k]], ids[p[k:]]): ids[p] for p in pieces for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.pair = Pairs(found)
        self.steps_back = np.zeros(size + 1, bool)
        made = set(found.values())
        for (a, b), n in found.items():
            for part in (a, b):
                if part in made and self.rank_of[n] <= self.rank_of[part]:
                    self.steps_back[part] = True
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for c in set("".join(pieces)):
            self.symbol_of[ord(c)] = ids[c]
        self.beside = Pairs({(ids[p[k]], ids[p[k + 1]]): 1 for p in pieces for k in range(len(p) - 1)})
        self.id_of = np.arange(size, dtype=np.int32)
        self.id_of[len(text_of) :] = -1
        self.whole_words = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.byte_value = {n: i for i, n in enumerate(bytes_of)}
        own = {n: p for p, (n, _) in pieces.items()}
        self.bare_of = [own[n].removeprefix(MARK).replace(MARK, " ").encode("utf-8") if n in own else t for n, t in enumerate(text_of)]
        self.blanks, self.blank_id = 0, b""
        self._try_blanks(pieces)

    def _try_blanks(self, pieces: dict[str, tuple[int, float]]) -> None:
        """Whether a run of blanks may be cut after the longest piece of them."""
        longest = max((len(p) for p in pieces if not p.strip(MARK)), default=0)
        if longest < 2 or len({s for p, (_, s) in pieces.items() if len(p) > 1 and not p.strip(MARK)}) > 1:
            return
        own = pieces[MARK * longest][0]
        if any(own in (a, b) for a, b in zip((self.pair.keys[:-1] >> 32).tolist(), (self.pair.keys[:-1] & 0xFFFFFFFF).tolist())):
            return
        raw = np.array([own], "<u4").tobytes()
        made = self.merge([MARK * n for n in range(1, 5 * longest)])
        if all(made[n + longest - 1] == raw + made[n - 1] for n in range(1, 4 * longest)):
            self.blanks, self.blank_id = longest, raw

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit numbers."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int32)
        if not len(codes):
            return [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        symbol = self.symbol_of[codes]
        last = np.zeros(len(codes), bool)  # of their segment
        last[ends[lengths > 0] - 1] = True
        last[:-1] |= self.beside(symbol[:-1], symbol[1:]) < 0
        out, alive = symbol.copy(), np.zeros(len(codes), bool)
        place = np.arange(len(codes))
        made = np.append(self.pair(symbol[:-1], symbol[1:]), np.int32(-1))
        made[last] = -1
        while len(symbol):
            rank = self.rank_of[made]
            starts = np.flatnonzero(np.concatenate(([True], last[:-1])))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbol)))
            open_ = np.repeat(least < NONE, sizes)
            if not open_.all():
                done = place[~open_]
                out[done], alive[done] = symbol[~open_], True
                symbol, place, made, last, rank = symbol[open_], place[open_], made[open_], last[open_], rank[open_]
                sizes, least = sizes[least < NONE], least[least < NONE]
                if not len(symbol):
                    break
            segment = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(rank == least[segment])
            run = np.concatenate(([True], np.diff(at) > 1))
            first = at[run][np.cumsum(run) - 1]
            taken = (at - first) % 2 == 0
            if (back := self.steps_back[made[at]]).any():
                begins = np.diff(segment[at], prepend=-1) > 0
                apart = begins | (np.diff(place[at], prepend=0) > 2 * self.most)
                careful = np.maximum.reduceat(back, np.flatnonzero(begins))[np.cumsum(begins) - 1]  # all of a segment
                taken = np.where(careful, apart, taken)
            at = at[taken]
            symbol[at] = made[at]
            last[at] = last[at + 1]
            kept = np.ones(len(symbol), bool)
            kept[at + 1] = False
            new = (np.cumsum(kept) - 1)[at]
            symbol, place, made, last = symbol[kept], place[kept], made[kept], last[kept]
            made[new[last[new]]] = -1
            for left in (new, new[new > 0] - 1):  # the pairs on both sides
                left = left[~last[left]]
                made[left] = self.pair(symbol[left], symbol[left + 1])
        ids = np.where(out >= 0, self.id_of[np.maximum(out, 0)], -1)[alive]
        edges = np.concatenate(([0], np.cumsum(alive)))[np.concatenate(([0], ends))]
        raw, bounds = ids.astype("<u4").tobytes(), (4 * edges).tolist()
        result = [raw[x:y] for x, y in zip(bounds, bounds[1:])]
        for n in np.unique(np.searchsorted(edges, np.flatnonzero(ids < 0), "right") - 1).tolist():
            result[n] = self._with_bytes(ids[edges[n] : edges[n + 1]], words[n])
        return result

    def _with_bytes(self, ids: np.ndarray, word: str) -> bytes:
        """Unknown characters as their bytes' pieces. What isn't unknown is a piece, so places tell the character."""
        out, at = [], 0
        for n in ids.tolist():
            if n < 0:
                out += [self.bytes_of[b] for b in word[at].encode("utf-8")]
                at += 1
            else:
                out.append(n)
                at += len(self.text_of[n].decode("utf-8"))  # type: ignore[union-attr]
        return np.array(out, "<u4").tobytes()

    def words(self, text: str) -> list[str]:
        """The parts of a text that no piece spans, blanks as marks."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return _RUNS(marked) if self.whole_words else [marked]

    def cut_blanks(self, word: str) -> tuple[int, str]:
        """How many of the longest pieces of blanks go before the rest of a word."""
        run = len(word) - len(word.lstrip(MARK))
        n = run // self.blanks - 2 if self.blanks else 0
        return (n, word[n * self.blanks :]) if n > 0 else (0, word)

    def decode(self, ids: Iterable[int]) -> str:
        parts, texts = [], self.text_of
        bare, run = True, bytearray()  # the first mark is yet to come; bytes that wait
        for n in ids:
            own = texts[n]
            if own is None:
                run.append(self.byte_value[n])
                bare = False
                continue
            if run:
                parts.append(_characters(run))
                run = bytearray()
            if bare and own:
                bare, own = False, self.bare_of[n]
            parts.append(own)
        parts.append(_characters(run))
        return b"".join(parts).decode("utf-8")


def _characters(raw: bytes | bytearray) -> bytes:
    """UTF-8, with U+FFFD for each byte that is part of no character."""
    if not raw:
        return b""
    try:
        bytes(raw).decode("utf-8")
        return bytes(raw)
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            part = bytes(raw[at : at + size])
            try:
                part.decode("utf-8")
            except UnicodeDecodeError:
                continue
            break
        else:
            part, size = "�".encode(), 1
        out.append(part)
        at += size
    return b"".join(out)


class Encoder:
    """A model with a memory of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.of_word = Memory(CACHE_ENTRIES)
        self.ends = np.array([model.begin], "<u4").tobytes(), np.array([model.end], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian 32-bit numbers; one call of rounds for all new words."""
        model, of_word = self.model, self.of_word
        split = [model.words(t) for t in texts]
        new = of_word.missing(set(chain.from_iterable(split)))
        cut = {w: model.cut_blanks(w) for w in new if w.startswith(LONG_RUN)}
        for word, ids in zip(new, model.merge([cut[w][1] if w in cut else w for w in new] if cut else new)):
            of_word[word] = model.blank_id * cut[word][0] + ids if word in cut else ids
        begin, end = self.ends
        found = [b"".join([begin, *map(of_word.__getitem__, own), end]) for own in split]
        for word in new:  # very long ones aren't kept
            if len(word) > 64:
                del of_word[word]
        return found

    def forget(self) -> None:
        self.of_word.clear()
        self.of_word.old = {}


def read_model(path: str) -> Model:
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, bytes_of, text_of = {}, [-1] * 256, []
    for n in range(own.get_piece_size()):
        piece = own.id_to_piece(n)
        if own.is_byte(n):
            bytes_of[int(piece[3:5], 16)] = n
            text_of.append(None)
        elif own.is_control(n):
            text_of.append(b"")
        elif own.is_unknown(n):
            text_of.append(" ⁇ ".encode())
        else:
            pieces[piece] = (n, own.get_score(n))
            text_of.append(piece.replace(MARK, " ").encode("utf-8"))
    return Model(pieces, bytes_of, text_of, own.bos_id(), own.eos_id())


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a worker process; the model file must be on every machine, as the tokenizer package is."""
    return Encoder(read_model(path))


Emit = Callable[[Encoder, np.ndarray, bytes], tuple[Any, ...]]


def _ids_and_text(own: Encoder, ids: np.ndarray, raw: bytes) -> tuple[Any, ...]:
    return len(ids), ids.tolist(), own.model.decode(ids.tolist())


def _digests(own: Encoder, ids: np.ndarray, raw: bytes) -> tuple[Any, ...]:
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(own.model.decode(ids.tolist()).encode("utf-8")).hexdigest()


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, emit: Emit = _ids_and_text, emitted: str = "n_tokens long, ids array<int>, decoded string"
) -> DataFrame:
    """Each document's ids, begin and end included, and the text that they decode to, or what ``emit`` makes of the ids.

    ``vocabulary`` is a model's name in the tokenizer package, or a path. One narrow pass: no shuffle, and a worker holds the
    ids of one chunk of documents at a time."""

    def start() -> Callable[..., Iterable[tuple[Any, ...]]]:
        import public_tokenizers

        own = encoder(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))

        def each(keys: list[Any], texts: list[str | None]) -> Iterable[tuple[Any, ...]]:
            return [(k, *emit(own, np.frombuffer(raw, "<u4"), raw)) for k, raw in zip(keys, own.encode([t or "" for t in texts]))]

        each.close = own.forget  # type: ignore[attr-defined]
        return each

    kind = docs.schema[id_col].dataType.simpleString()
    return map_chunks(docs, [id_col, text_col], start, f"{id_col} {kind}, {emitted}")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), emit=_digests, emitted="n_tokens long, ids_sha256 string, decoded_sha256 string")


QUERIES = {"op12_sentencepiece": op12_sentencepiece}
ORACLES: dict[str, str] = {}
