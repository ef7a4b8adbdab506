"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation of a text is the path of pieces with the largest sum of scores. The search keeps a window as
long as the longest piece: only positions in it can begin a piece that is still open. Whenever the paths back from
all of them meet in one boundary, the ids up to it are final and are handed out, so memory does not grow with the text.

Paths meet for sure between two characters that no piece holds side by side, such as before a word. A text is cut
there first, all stretches in between are searched side by side, a step of numpy for a position of all of them,
and each hands out its ids where it ends. Equal stretches are searched once, and a bounded number is remembered.
``stream`` is the same search for one text a character at a time, which finds where paths meet by following them
back; stretches of more than ``LANE`` characters go through it.

A blank is written as U+2581, one stands before every text, and characters without a piece are written as
their UTF-8 bytes (so is U+2581 itself, which makes decoding exact). Equal sums are decided for the longer
last piece. Pieces and stretches are told apart by 64-bit hashes.

The ids are the best path under the model's scores. A model of merges (BPE) holds ranks for scores, and its own library
merges by rank instead of searching, so its ids differ; decoding gives the text back either way.

Defined results: a null text is an empty one and has no ids; a null doc_id is an id like any other; repeated
rows each get a row; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import filled, slices
from tarnlake.llm.words import BASE, mix

BLANK = "▁"
UNFIT = 0x110000  # stands for a U+2581 of the text, which no piece matches
LANE = 96
CACHED_CHARACTERS = 4 << 20
BLOCK = 1 << 20
_SMALL = 0x250  # characters below it, and the blank, have their pairs in a table
_U = np.uint64


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def characters(text: str) -> np.ndarray:
    """The marked text: blanks are U+2581 and a U+2581 is ``UNFIT``."""
    found = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    found[found == ord(BLANK)] = UNFIT
    found[found == 32] = ord(BLANK)
    return found


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class _Hashes:
    """Hashes of spans of an array of characters; equal spans have equal hashes wherever they stand."""

    up = down = np.empty(0, np.uint64)

    def __init__(self, found: np.ndarray):
        n = len(found)
        if n >= len(_Hashes.up):
            _Hashes.up = _powers(max(n + 1, BLOCK), BASE)
            _Hashes.down = _powers(max(n + 1, BLOCK), pow(BASE, -1, 1 << 64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix((found + 1).astype(np.uint64) * _U(BASE)) * _Hashes.up[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * _Hashes.down[starts] + (ends - starts).astype(np.uint64) * _U(0x9E3779B1)


class Pieces:
    """The pieces of a SentencePiece model file, with their scores and byte ids."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.by_id: list[str | int | None] = []
        scores: dict[str, tuple[float, int]] = {}
        self.byte_ids: dict[int, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.by_id.append(int(piece[3:5], 16))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.by_id.append(None)
            else:
                self.by_id.append(piece)
                scores[piece] = (model.get_score(i), i)
        self.scores = scores
        self.longest = max(map(len, scores))
        # A character of its own bytes is worse than any path through pieces of the same length.
        self.byte_score = min(-1e6, 10 * min((s for s, _ in scores.values() if s > -1e8), default=0.0))
        self._index()
        self._forget()

    def _index(self) -> None:
        """Pieces by hash, pairs of characters that stand side by side in one, and the bytes of each id."""
        named = list(self.scores)
        text = np.frombuffer("".join(named).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(p) for p in named])
        starts = ends - [len(p) for p in named]
        hashes = _Hashes(text).of(starts, ends)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        self.key_scores = np.array([self.scores[p][0] for p in named])[order]
        self.key_ids = np.array([self.scores[p][1] for p in named], np.int64)[order]
        inside = np.ones(len(text), bool)
        inside[starts] = False
        at = np.flatnonzero(inside)
        self.pairs = np.unique(text[at - 1] << 32 | text[at])
        self.small_pairs = np.zeros((_SMALL + 1, _SMALL + 1), bool)
        before, after = self._small(self.pairs >> 32), self._small(self.pairs & 0xFFFFFFFF)
        both = (before >= 0) & (after >= 0)
        self.small_pairs[before[both], after[both]] = True
        raw = [b"" if p is None else bytes([p]) if isinstance(p, int) else p.replace(BLANK, " ").encode() for p in self.by_id]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_ends = np.cumsum([0] + [len(r) for r in raw])

    @staticmethod
    def _small(found: np.ndarray) -> np.ndarray:
        return np.where(found < _SMALL, found, np.where(found == ord(BLANK), _SMALL, -1))

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.known_at = np.empty(0, np.int64)  # where the ids of each begin in ``ids``
        self.known_size = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def meetings(self, found: np.ndarray) -> np.ndarray:
        """For each character whether all paths have a boundary before it, because no piece holds it with the one before."""
        sure = np.ones(len(found), bool)
        small = self._small(found)
        a, b = small[:-1], small[1:]
        sure[1:] = ~self.small_pairs[a, b]
        at = np.flatnonzero((a < 0) | (b < 0))
        wide = found[at] << 32 | found[at + 1]
        place = np.minimum(np.searchsorted(self.pairs, wide), len(self.pairs) - 1)
        sure[at + 1] = self.pairs[place] != wide
        return sure

    def stream(self, text: Iterable[str]) -> Iterator[tuple[int, ...]]:
        """Ids, handed out as soon as all surviving paths agree on them.

        ``text`` gives the characters of the marked text; a blank stands for U+2581, which stands for itself.
        """
        scores, longest = self.scores, self.longest
        window = ""  # what is not committed; a U+2581 of the text is written as a character no piece has
        score = [0.0]  # by position in the window
        back: list[tuple[int, tuple[int, ...]]] = [(0, ())]  # the position before, and the ids in between
        look = 2 * longest
        for character in text:
            window += BLANK if character == " " else "\ud800" if character == BLANK else character
            end = len(window)
            best, came, ids = float("-inf"), 0, ()
            for start in range(max(0, end - longest), end):
                found = scores.get(window[start:end])
                if found is not None and score[start] + found[0] > best:
                    best, came, ids = score[start] + found[0], start, (found[1],)
            if best == float("-inf"):
                raw = BLANK if character == " " else character
                best, came = score[end - 1] + self.byte_score, end - 1
                ids = tuple(self.byte_ids[b] for b in raw.encode("utf-8", "surrogatepass"))
            score.append(best)
            back.append((came, ids))
            if end >= look:
                agreed = self._meeting(back, end)
                if agreed:
                    yield self._path(back, agreed)
                    window, score = window[agreed:], [s - score[agreed] for s in score[agreed:]]
                    back = [(max(0, p - agreed), i) for p, i in back[agreed:]]
                look = max(2 * longest, len(window) + longest)
        yield self._path(back, len(window))

    def _meeting(self, back: list[tuple[int, tuple[int, ...]]], end: int) -> int:
        """The last position that all paths from the open positions go through."""
        open_positions = set(range(max(0, end - self.longest + 1), end + 1))
        while len(open_positions) > 1:
            latest = max(open_positions)
            open_positions.remove(latest)
            open_positions.add(back[latest][0])
        return open_positions.pop()

    @staticmethod
    def _path(back: list[tuple[int, tuple[int, ...]]], end: int) -> tuple[int, ...]:
        steps = []
        while end > 0:
            end, ids = back[end]
            steps.append(ids)
        return tuple(i for ids in reversed(steps) for i in ids)

    def _searched(self, found: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some stretches of ``found``, one after the other, and how many each has."""
        sizes = np.zeros(len(starts), np.int64)
        long = ends - starts > LANE
        parts: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(long).tolist():
            text = (chr(c) if c != UNFIT else BLANK for c in np.where(found == ord(BLANK), 32, found)[starts[i] : ends[i]].tolist())
            parts[i] = np.array([x for ids in self.stream(text) for x in ids], np.int64)
            sizes[i] = len(parts[i])
        short = np.flatnonzero(~long)
        short = short[np.argsort(starts[short] - ends[short], kind="stable")]  # longest first, so active lanes come first
        made, at = [], 0
        while at < len(short):
            lengths = (ends - starts)[short[at : at + BLOCK // 8]]
            take = max(1, int(np.searchsorted(np.cumsum(lengths), BLOCK // 4)))
            lanes = short[at : at + take]
            ids, counts = self._lanes(found, starts[lanes], ends[lanes])
            sizes[lanes] = counts
            made.append((lanes, ids, counts))
            at += take
        stops = np.cumsum(sizes)
        out = np.empty(stops[-1] if len(stops) else 0, np.int64)
        begin = stops - sizes
        for i, ids in parts.items():
            out[begin[i] : stops[i]] = ids
        for lanes, ids, counts in made:
            out[_ragged(begin[lanes], counts)] = ids
        return out, sizes

    def _lanes(self, found: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for stretches side by side, longest first: every step passes one character of all that have it."""
        n = ends - starts
        text = found[_ragged(starts, n)]
        at = np.cumsum(n) - n  # each lane's first character in ``text``
        passed = np.arange(len(text)) - np.repeat(at, n) + 1
        width = int(min(self.longest, n[0]))
        hashes = _Hashes(text)
        score = np.full((len(text), width), -np.inf)  # of the piece of ``width - column`` characters that ends here
        piece = np.zeros((len(text), width), np.int32)
        for size in range(1, width + 1):
            last = np.flatnonzero(passed >= size)
            key = hashes.of(last + 1 - size, last + 1)
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            score[last[hit], width - size] = self.key_scores[place[hit]]
            piece[last[hit], width - size] = self.key_ids[place[hit]]
        node = at + np.arange(len(n))  # a lane has a node more than characters
        # The window: of each lane the best scores at its last ``width`` positions, the oldest first.
        window = np.full((len(n), width), -np.inf)
        window[:, -1] = 0.0
        size_back = np.zeros(len(text) + len(n), np.int64)
        id_back = np.zeros(len(text) + len(n), np.int64)
        active = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")
        for step, m in enumerate(active.tolist()):
            here = at[:m] + step
            sums = window[:m] + score[here]
            column = np.argmax(sums, axis=1)  # the first of equal ones is the longest piece
            row = np.arange(m)
            best = sums[row, column]
            size, ids = width - column, piece[here, column].astype(np.int64)
            none = best == -np.inf
            if none.any():
                best[none] = window[:m][none, -1] + self.byte_score
                size[none] = 1
                ids[none] = -text[here[none]] - 1
            window[:m, :-1] = window[:m, 1:]
            window[:m, -1] = best
            size_back[node[:m] + step + 1] = size
            id_back[node[:m] + step + 1] = ids
        left, lane, order, taken = n.copy(), [], [], []
        live, k = np.arange(len(n)), 0
        while len(live):
            spot = node[live] + left[live]
            lane.append(live)
            order.append(np.full(len(live), k))
            taken.append(id_back[spot])
            left[live] -= size_back[spot]
            live, k = live[left[live] > 0], k + 1
        lane, order, taken = np.concatenate(lane), np.concatenate(order), np.concatenate(taken)
        taken = taken[np.lexsort((-order, lane))]
        lane = np.sort(lane, kind="stable")
        return self._with_bytes(taken, lane, len(n))

    def _with_bytes(self, taken: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids, where a negative number stands for the bytes of a character; and how many each lane has."""
        odd = np.flatnonzero(taken < 0)
        if not len(odd):
            return taken, np.bincount(lane, minlength=lanes)
        size = np.ones(len(taken), np.int64)
        codes = -taken[odd] - 1
        raw = {c: [self.byte_ids[b] for b in (BLANK if c == UNFIT else chr(c)).encode("utf-8", "surrogatepass")] for c in set(codes.tolist())}
        size[odd] = [len(raw[c]) for c in codes.tolist()]
        out = np.repeat(taken, size)
        first = np.cumsum(size) - size
        for at, c in zip(first[odd].tolist(), codes.tolist()):
            out[at : at + len(raw[c])] = raw[c]
        return out, np.bincount(lane, weights=size, minlength=lanes).astype(np.int64)

    def _codes(self, found: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of every stretch begin in ``self.ids`` and how many they are; new ones are searched."""
        distinct, first, code = np.unique(_Hashes(found).of(starts, ends), return_index=True, return_inverse=True)
        if len(self.ids) > CACHED_CHARACTERS:
            self._forget()
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != distinct[inside]
        if new.any():
            ids, sizes = self._searched(found, starts[first[new]], ends[first[new]])
            begin = len(self.ids) + np.cumsum(sizes) - sizes
            self.known_at = np.insert(self.known_at, place[new], begin)
            self.known_size = np.insert(self.known_size, place[new], sizes)
            self.known = np.insert(self.known, place[new], distinct[new])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            place = np.searchsorted(self.known, distinct)
        return self.known_at[place][code], self.known_size[place][code]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        found = characters("".join(" " + text for text in texts if text))
        lengths = np.array([len(text) + 1 if text else 0 for text in texts], np.int64)
        if not len(found):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        sure = self.meetings(found)
        begin = np.cumsum(lengths) - lengths
        sure[begin[lengths > 0]] = True
        starts = np.flatnonzero(sure)
        place, sizes = self._codes(found, starts, np.append(starts[1:], len(found)))
        stops = np.concatenate([[0], np.cumsum(sizes)])
        edges = np.searchsorted(starts, np.append(begin, len(found)))
        return self.ids[_ragged(place, sizes)], np.diff(stops[edges])

    def encode_parts(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text of any length, part by part."""
        text, at = (" " + text if text else ""), 0
        while at < len(text):
            part = characters(text[at : at + BLOCK])
            sure = self.meetings(part)
            sure[0] = True
            if at + BLOCK < len(text):
                stop = int(np.flatnonzero(sure)[-1])
                if not stop:  # no place where paths surely meet
                    yield from (np.array(ids, np.int32) for ids in self.stream(iter(text[at:])))
                    return
                part, sure = part[:stop], sure[:stop]
            starts = np.flatnonzero(sure)
            yield self.ids[_ragged(*self._codes(part, starts, np.append(starts[1:], len(part))))]
            at += len(part)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for, blanks as blanks."""
        begin = self.raw_ends[ids]
        return self.raw[_ragged(begin, self.raw_ends[ids + 1] - begin)]

    def decode(self, ids: Iterable[int]) -> str:
        found = self.decode_bytes(np.fromiter(ids, np.int64)).tobytes()
        return found.decode("utf-8", "surrogatepass")[1:]

    def digest(self, texts: list[str]) -> Iterator[tuple[int, int, int, bool]]:
        """n_chars, n_ids, crc32 of the ids and whether they decode to the text, of each text."""
        if len(texts) == 1 and len(texts[0]) > BLOCK:
            yield self._long_digest(texts[0])
            return
        ids, sizes = self.encode_all(texts)
        raw = np.frombuffer("".join(" " + text for text in texts if text).encode("utf-8", "surrogatepass"), np.uint8)
        decoded = self.decode_bytes(ids)
        stops = np.cumsum(sizes)
        ends = np.concatenate([[0], np.cumsum(self.raw_ends[ids + 1] - self.raw_ends[ids])])[np.concatenate([[0], stops])]
        at = 0
        for i, text in enumerate(texts):
            part = ids[stops[i] - sizes[i] : stops[i]].astype("<u4")
            n_bytes = len(text.encode("utf-8", "surrogatepass")) + 1 if text else 0
            same = ends[i + 1] - ends[i] == n_bytes and np.array_equal(raw[at : at + n_bytes], decoded[ends[i] : ends[i + 1]])
            at += n_bytes
            yield len(text), len(part), zlib.crc32(part.tobytes()), bool(same)

    def _long_digest(self, text: str) -> tuple[int, int, int, bool]:
        crc, count, at, same = 0, 0, 0, True
        raw = (" " + text).encode("utf-8", "surrogatepass")
        for ids in self.encode_parts(text):
            crc, count = zlib.crc32(ids.astype("<u4").tobytes(), crc), count + len(ids)
            decoded = self.decode_bytes(ids).tobytes()
            same = same and raw[at : at + len(decoded)] == decoded
            at += len(decoded)
        return len(text), count, crc, same and at == len(raw)


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row of ``docs``: doc_id and ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_path)
        for batch in slices(batches):
            ids, sizes = pieces.encode_all(filled(batch["text"]).to_pylist())
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, ids array<int>")


def decoded(encoded_docs: DataFrame, model_path: str) -> DataFrame:
    """Per row of ``encoded_docs`` (doc_id, ids): doc_id and the text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_path)
        for batch in batches:
            texts = [pieces.decode(ids or []) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts)], names=["doc_id", "text"])

    return encoded_docs.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, n_ids, ids_crc32 (unsigned 32-bit little-endian ids), round_trip."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_path)
        for batch in slices(batches):
            found = pieces.digest(filled(batch["text"]).to_pylist())
            columns = list(zip(*found))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, kinds))],
                names=["doc_id", "n_chars", "n_ids", "ids_crc32", "round_trip"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        rows, "doc_id long, n_chars long, n_ids long, ids_crc32 long, round_trip boolean"
    )
