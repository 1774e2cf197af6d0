"""SentencePiece encoding and decoding with a given BPE model, by a max-plus scan over chunks.

A segmentation is the model's own exactly if every two neighbouring pieces are *stable*: merging the
characters of the two by the model's rule gives the two back. (Merges within two neighbours happen in
the same order whether or not more text stands around them, so the first merge across a boundary would
show in the pair already.) So a step from piece to piece weighs 0 if stable and minus infinity if not,
and the encoding is the one path of weight 0: a Viterbi path over pieces in the max-plus semiring.

A text is cut into chunks at fixed places. The state at a cut is the piece that covers the character
before it. A chunk's transfer matrix tells which states at its end each state at its beginning leads
to. Matrices are made in parallel and combined by the associative max-plus product in a tree, FAN neighbours
to a product, any number of products at once. From the root down, a product's states at its two ends tell
those of its parts; once each chunk's are known, chunks are backtraced independently. No task holds more
than FAN matrices of a text at a time. A text of one chunk has one state at either end.
Where no piece spans two neighbouring characters (before a space mark, at line feeds) every path has a
boundary, so between two such places a stretch is encoded on its own, and cached.

Normalisation is the model's: white space escaped, one mark put in front; nothing else changes. Null and
empty texts have no ids.
"""

from __future__ import annotations

import ast
import functools
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Characters of a chunk. Longer texts are cut, and their chunks are spread over tasks.
CHUNK = 1 << 15
#: Stretches whose ids a worker remembers.
REMEMBERED = 300_000
#: Pairs of pieces of which a worker remembers whether they are stable.
REMEMBERED_PAIRS = 400_000
#: Neighbouring matrices that one product takes.
FAN = 16
START, END = -1, -2


def is_word(c: str) -> bool:
    return c.isalpha() or c.isdecimal()


# the same as a character class: what re calls a word character, without the underscore and other numerals
_IN_WORD = "".join(c for c in map(chr, range(0x110000)) if c.isalnum() and not is_word(c))
_WORD = f"[^\\W_{_IN_WORD}]"


class Model:
    """Pieces, scores and byte ids of a BPE model with byte fallback."""

    def __init__(self, path: str, remembered: int = REMEMBERED, pairs: int = REMEMBERED_PAIRS):
        import sentencepiece

        self.remembered, self.most_pairs = remembered, pairs

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.unk = sp.unk_id()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        bytes_ = [i for i in range(n) if sp.is_byte(i)]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in bytes_}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.ids = {self.pieces[i]: i for i in range(n) if i not in special and i not in self.byte_of}
        self.written = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        spans = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.marks_lead = all(s[1] != MARK or s[0] == MARK for s in spans)
        self.no_feed = not any("\n" in s for s in spans)
        # most vocabularies don't mix letters and digits with other characters in a piece
        self.apart = self.marks_lead and self.no_feed and all(is_word(x) == is_word(y) for x, y in spans if MARK not in (x, y))
        self.stretch = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+" if self.marks_lead and self.no_feed else "(?s).+")
        self.part = re.compile(f"{MARK}*(?:{_WORD}+|(?:(?![{MARK}\n])[\\W_{_IN_WORD}])+)|{MARK}+|\n+" if self.apart else "(?s).+")
        # a piece that the rule does not make of its own characters is in no path
        self.makes = {p for p in self.ids if self.merged(p) == [p]}
        ends: dict[str, set[int]] = {}
        for p in self.makes:
            if len(p) > 1:
                ends.setdefault(p[-2:], {1}).add(len(p))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self._stable: dict[str, dict[str, bool]] = {}
        self._pairs = 0
        self._seen: dict[str, bytes] = {}
        self._packed: dict[str, bytes] = {}
        self._met = np.zeros(1 << 23, bool)

    def merged(self, text: str) -> list[str]:
        """The model's rule itself: merge the neighbours whose union has the best score, the leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stable(self, a: str, b: str) -> bool:
        after = self._stable.get(a)
        if after is None:
            after = self._stable[a] = {}
        known = after.get(b)
        if known is None:
            self._pairs += 1
            if self._pairs > self.most_pairs:
                self._stable.clear()
                self._stable[a] = after = {}
                self._pairs = 1
            known = after[b] = self.merged(a + b) == [a, b]
        return known

    def steps_from(self, text: str, at: int, before: str | None) -> Iterator[int]:
        """Ends of the pieces that may stand at `at` after the piece `before` (None: at a boundary of all paths)."""
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            piece = text[at:end]
            if (end == at + 1 or piece in self.makes) and (before is None or self.stable(before, piece)):
                yield end

    def path(self, text: str) -> list[str]:
        """The stable path from the first to the last character."""
        return next(self.paths([text]))

    def paths(self, texts: list[str]) -> Iterator[list[str]]:
        """The stable path of each text. last[i]: the piece that ends at i on the path to i.

        Each prefix has one stable path, so one piece is enough for each place, and texts in sorted
        order go on from the prefix that they share with the one before.
        """
        makes, lengths, stable, known = self.makes, self.lengths, self.stable, self._stable
        before = ""
        last: list[str] = [""]
        for text in texts:
            n, k = len(text), 0
            most = min(n, len(before))
            while k < most and text[k] == before[k]:
                k += 1
            del last[k + 1 :]
            for i in range(k + 1, n + 1):
                for size in lengths.get(text[i - 2 if i > 1 else 0 : i], (1,)):
                    s = i - size
                    if s < 0:
                        continue
                    piece = text[s:i]
                    if size > 1 and piece not in makes:
                        continue
                    if s:
                        after = known.get(last[s])
                        ok = None if after is None else after.get(piece)
                        if not (stable(last[s], piece) if ok is None else ok):
                            continue
                    last.append(piece)
                    break
            before = text
            out, i = [], n
            while i:
                out.append(last[i])
                i -= len(last[i])
            yield out[::-1]

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unk)
        return out

    def normalised(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def packed(self, piece: str) -> bytes:
        """A piece's ids as packed 32-bit integers."""
        got = self._packed.get(piece)
        if got is None:
            got = np.array(self.ids_of([piece]), np.int32).tobytes()
            if len(piece) > 1 or piece in self.ids:
                self._packed[piece] = got
        return got

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Of normalised texts of one chunk each; stretches that are new are encoded once, in sorted order."""
        cut = list(map(self.stretch.findall, texts))
        seen = self._seen
        part = self.part.findall
        words = {w: [w] if w[w[0] == MARK :].isalpha() else part(w) for w in set(chain.from_iterable(cut)).difference(seen)}
        parts = sorted(set(chain.from_iterable(words.values())).difference(seen))
        packed = self.packed
        for w, pieces in zip(parts, self.paths(parts), strict=True):
            seen[w] = b"".join(map(packed, pieces))
        for w, inside in words.items():
            if len(inside) > 1:
                seen[w] = b"".join(map(seen.__getitem__, inside))
        out = [np.frombuffer(b"".join(map(seen.__getitem__, c)), np.int32) for c in cut]
        self._forget([*{*parts, *words}])
        return out

    def _forget(self, added: list[str]) -> None:
        """Of new stretches, keeps all while there is much room, then those met before, then none."""
        if 2 * len(self._seen) < self.remembered:
            return
        at = np.fromiter(map(hash, added), np.int64, len(added)) & (len(self._met) - 1)
        again = self._met[at] & (len(self._seen) <= self.remembered)
        self._met[at] = True
        for w, keep in zip(added, again.tolist(), strict=True):
            if not keep:
                del self._seen[w]

    def encode_whole(self, text: str) -> np.ndarray:
        return self.encode_texts([text])[0]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8, but for a piece's bytes that are none."""
        text = b"".join(map(self.written.__getitem__, ids.tolist()))
        return text[1:] if text[:1] == b" " else text

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")

    # --- chunks -------------------------------------------------------------------------------------

    def boundary(self, text: str, at: int) -> bool:
        """Whether all paths have a boundary before text[at]; 0 < at < len(text)."""
        a, b = text[at - 1], text[at]
        if a == MARK or b == MARK:
            return self.marks_lead and b == MARK and a != MARK or self.no_feed and "\n" in (a, b)
        return self.no_feed and "\n" in (a, b) or self.apart and is_word(a) != is_word(b)

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """(start, end) of the pieces that may cover the character before the cut."""
        out = []
        for s in range(max(0, cut - self.longest), cut):
            for e in range(cut, min(len(text), s + self.longest) + 1):
                piece = text[s:e]
                if (e - s == 1 or piece in self.makes) and not any(self.boundary(text, k) for k in range(s + 1, e)):
                    out.append((s, e))
        return out

    def bounds(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """The first and the last boundary of all paths from low to high, both included."""
        n = len(text)
        first = next((k for k in range(max(1, low), min(high, n - 1) + 1) if self.boundary(text, k)), None)
        if first is None:
            return None
        return first, next(k for k in range(min(high, n - 1), first - 1, -1) if self.boundary(text, k))

    def transfer(self, text: str, begin: int, cut: int, first: bool, final: bool) -> dict:
        """{state at begin: set of states at cut that it leads to}: the finite entries of the matrix.

        text reaches `longest` characters beyond both ends where there is more. All paths go through
        the boundaries of all paths, so only what is before the first and after the last is walked.
        """
        between = self.bounds(text, begin, cut - 1)
        if between is None:
            out = self._walk(text, begin, cut, first)
        else:
            head = self._reach(text, begin, between[0], first)
            tail = self._walk(text, between[1], cut, True)[START]
            out = {e: set(tail) if ok else set() for e, ok in head.items()}
        if final:
            out = {e: {END} if any(x[1] == cut for x in to if x != END) else set() for e, to in out.items()}
        return out

    def _reach(self, text: str, begin: int, place: int, first: bool) -> dict:
        """Which states at begin lead to a boundary at `place`, with no boundary in between."""
        if first and place == begin:
            return {START: True}
        found = {}
        for e in [START] if first else self.states(text, begin):
            if e != START and e[1] >= place:
                found[e] = e[1] == place
            else:
                start, before = (begin, None) if e == START else (e[1], text[e[0] : e[1]])
                pieces = self.path(("" if before is None else before) + text[start:place])
                found[e] = before is None or pieces[0] == before
        return found

    def _walk(self, text: str, begin: int, cut: int, first: bool) -> dict:
        """The matrix of a stretch without boundaries of all paths; with `first`, of paths that begin at `begin`.

        Paths that have met in a place with the same piece go on together, so the work is that of the
        different pieces per place.
        """
        entries = [START] if first else self.states(text, begin)
        # (place, piece before it) -> the entries whose paths are there
        at: dict[int, dict[str | None, set]] = {}
        out: dict = {e: set() for e in entries}
        for e in entries:
            place, piece = (begin, None) if e == START else (e[1], text[e[0] : e[1]])
            if e != START and place >= cut:
                out[e].add(e)  # one piece covers the whole chunk
            else:
                at.setdefault(place, {}).setdefault(piece, set()).add(e)
        for place in range(begin, cut):
            for piece, who in at.pop(place, {}).items():
                for end in self.steps_from(text, place, piece):
                    if any(self.boundary(text, k) for k in range(place + 1, end)):
                        break
                    if end >= cut:
                        for e in who:
                            out[e].add((place, end))
                    else:
                        at.setdefault(end, {}).setdefault(text[place:end], set()).update(who)
        return out

    def trace(self, text: str, begin: int, cut: int, entry: tuple[int, int] | int, leave: tuple[int, int] | int) -> list[int]:
        """The ids of the pieces after the entry state up to and with the one of the state at the cut."""
        if entry != START and leave == entry:
            return []
        start, before = (begin, "") if entry == START else (entry[1], text[entry[0] : entry[1]])
        end = cut if leave == END else leave[1]
        between = self.bounds(text, start, (cut if leave == END else leave[0]) - (leave == END))
        if between is None or between[0] > end:
            return self.ids_of(self.path(before + text[start:end])[before != "" :])
        low, high = between
        head = self.path(before + text[start:low])[before != "" :]
        return [*self.ids_of(head), *self.encode_whole(text[low:high]).tolist(), *self.ids_of(self.path(text[high:end]))]


def product(a: dict, b: dict) -> dict:
    """The max-plus product of two transfer matrices with entries 0, by their finite entries."""
    return {s: set().union(*(b.get(m, set()) for m in to)) if to else set() for s, to in a.items()}


_models: dict[tuple, Model] = {}


def model(path: str, small: bool = False) -> Model:
    """A worker's model; a small one remembers less, for workers that also do other things."""
    if (path, small) not in _models:
        _models[path, small] = Model(path, REMEMBERED // 4, REMEMBERED_PAIRS // 3) if small else Model(path)
    return _models[path, small]


def _absolute(state, shift: int):
    return state if isinstance(state, int) else (state[0] + shift, state[1] + shift)


def chunk_matrix(m: Model, text: str, begin: int, cut: int, shift: int, first: bool, final: bool) -> dict:
    """transfer(), with states by their places in the whole text."""
    return {_absolute(e, shift): {_absolute(x, shift) for x in to} for e, to in m.transfer(text, begin, cut, first, final).items()}


def inner_states(matrices: list[dict], entry=START, leave=END) -> list[tuple]:
    """(state at its beginning, state at its end) of each of some neighbouring matrices, given those of them together.

    A pass from the end tells which states can still reach it; then each state follows in order.
    """
    n = len(matrices)
    good: list[set] = [set()] * n + [{leave}]
    for k in range(n - 1, -1, -1):
        good[k] = {s for s, to in matrices[k].items() if to & good[k + 1]}
    out, state = [], entry
    for k in range(n):
        (after,) = matrices[k][state] & good[k + 1]  # there is one stable path
        out.append((state, after))
        state = after
    return out


def tree_states(matrices: list[dict], fan: int = FAN) -> list[tuple]:
    """inner_states() of a whole text by products in a tree; what encode() does over a cluster."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([functools.reduce(product, last[k : k + fan]) for k in range(0, len(last), fan)])
    states = [(START, END)] * len(levels[-1])
    for below in reversed(levels[:-1]):
        states = [s for k, (a, z) in enumerate(states) for s in inner_states(below[k * fan : (k + 1) * fan], a, z)]
    return states


def _write(matrix: dict) -> str:
    return repr(sorted(((e, sorted(to, key=repr)) for e, to in matrix.items()), key=repr))


def _read(text: str) -> dict:
    return {e: set(to) for e, to in ast.literal_eval(text)}


def cut_places(n: int, chunk: int = CHUNK) -> list[int]:
    return [*range(chunk, n, chunk), n] if n else []


def encode_by_chunks(m: Model, text: str, chunk: int) -> list[int]:
    """A normalised text's ids by the chunked scan, in one process; what encode() does over a cluster."""
    if not text:
        return []
    pieces = []
    for part in chunk_parts(m, text, chunk):
        pieces.append(chunk_matrix(m, *part))
    out: list[int] = []
    for part, (a, b) in zip(chunk_parts(m, text, chunk), tree_states(pieces), strict=True):
        t, begin, cut, shift, *_ = part
        out += m.trace(t, begin, cut, _absolute(a, -shift), _absolute(b, -shift))
    return out


def chunk_parts(m: Model, text: str, chunk: int) -> Iterator[tuple[str, int, int, int, bool, bool]]:
    """(text with its surroundings, begin, cut, shift, first, final) of each chunk."""
    begin = 0
    n = len(text)
    for cut in cut_places(n, chunk):
        low, high = max(0, begin - m.longest), min(n, cut + m.longest)
        yield text[low:high], begin - low, cut - low, low, begin == 0, cut == n
        begin = cut


def _crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def encode(df: DataFrame, path: str, chunk: int = CHUNK, digests: bool = False, small: bool = False) -> DataFrame:
    """(doc_id, ids, n_chunks, text_crc32) for every row of df (doc_id, text).

    Texts of one chunk are encoded where they are read. Chunks of longer ones become rows, dealt over
    tasks; only their matrices are brought together by text. With digests, what digest() says of the
    rows, which then need not leave the task that encoded them. small: workers remember less.
    """
    frame = df.select("doc_id", "text")
    kind = frame.schema["doc_id"].dataType.simpleString()
    long = F.coalesce(F.length("text"), F.lit(0)) >= chunk  # the mark in front counts too

    @common.lean
    def straight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, small)
        for b in batches:
            column = common.texts_of(b.column(1))
            for low, high in common.steps(column, 1 << 20):
                texts = column.slice(low, high - low).to_pylist()
                ids = m.encode_texts([m.normalised(t) for t in texts])
                at = np.zeros(len(ids) + 1, np.int64)
                np.cumsum([len(x) for x in ids], out=at[1:])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(ids)))
                crc, n = pa.array(map(_crc, texts), pa.int64()), pa.array([int(t != "") for t in texts], pa.int32())
                out = pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), lists, n, crc], ["doc_id", "ids", "n_chunks", "text_crc32"])
                yield _digested(m, out) if digests else out

    @common.lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, small)
        for b in batches:
            for i, scalar in enumerate(b.column(1)):
                text = m.normalised(scalar.as_py())
                parts = list(chunk_parts(m, text, chunk))
                n, crc = len(parts), _crc(scalar.as_py())
                at = pa.array([i] * n, pa.int64())
                cols = [
                    pa.array([x[0] for x in parts], pa.string()),
                    pa.array([[*map(int, x[1:])] for x in parts], pa.list_(pa.int64())),
                    pa.array(range(n), pa.int32()),
                    pa.array([n] * n, pa.int32()),
                    pa.array([crc] * n, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), *cols], ["doc_id", "_row", "part", "place", "k", "n", "crc"])

    schema = DIGESTS if digests else "ids array<int>, n_chunks int, text_crc32 bigint"
    done = frame.filter(~long).mapInArrow(straight, f"doc_id {kind}, {schema}")
    parts = frame.filter(long).withColumn("_row", F.monotonically_increasing_id()).mapInArrow(cut, f"doc_id {kind}, _row bigint, part string, place array<bigint>, k int, n int, crc bigint")
    long = common.table(parts.repartition("_row", "k"), "chunks")

    @common.lean
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, small)
        for b in batches:
            rows = b.to_pydict()
            out = []
            for part, place in zip(rows["part"], rows["place"], strict=True):
                begin, end, shift, first, final = place
                out.append(_write(chunk_matrix(m, part, begin, end, shift, bool(first), bool(final))))
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("k"), pa.array(out, pa.string())], ["_row", "k", "matrix"])

    @common.lean
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_write(functools.reduce(product, (_read(x["matrix"]) for x in some))) for some in b.column("m").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("k"), pa.array(out, pa.string())], ["_row", "k", "matrix"])

    @common.lean
    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = lambda x: x[0] if len(x) == 1 else tuple(x)
        for b in batches:
            row, k, entry, leave = [], [], [], []
            for r, some, a, z in zip(*(b.column(c).to_pylist() for c in ("_row", "m", "entry", "leave")), strict=True):
                for x, (s, t) in zip(some, inner_states([_read(x["matrix"]) for x in some], state(a), state(z)), strict=True):
                    row.append(r)
                    k.append(x["k"])
                    entry.append([s] if isinstance(s, int) else list(s))
                    leave.append([t] if isinstance(t, int) else list(t))
            pairs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(k, pa.int32()), pa.array(entry, pairs), pa.array(leave, pairs)], ["_row", "k", "entry", "leave"])

    @common.lean
    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, small)
        for b in batches:
            out = []
            rows = b.select(["part", "place", "entry", "leave"]).to_pydict()
            for part, place, a, z in zip(rows["part"], rows["place"], rows["entry"], rows["leave"], strict=True):
                begin, end, shift = place[:3]
                ends = [x[0] if len(x) == 1 else (x[0] - shift, x[1] - shift) for x in (a, z)]
                out.append(m.trace(part, begin, end, *ends))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_row"), b.column("k"), b.column("n"), b.column("crc"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "_row", "k", "n", "crc", "ids"])

    def gathered(level: DataFrame) -> DataFrame:
        """FAN neighbours of a level to a row."""
        parent = F.floor(F.col("k") / FAN).cast("int")
        return level.groupBy("_row", parent.alias("up")).agg(F.sort_array(F.collect_list(F.struct("k", "matrix"))).alias("m")).withColumnRenamed("up", "k")

    matrices = long.select("_row", "part", "place", "k").mapInArrow(measure, "_row bigint, k int, matrix string")
    levels = [common.table(matrices, "matrices")]
    most = long.agg(F.max("n")).first()[0] or 1
    while most > 1:
        most = -(-most // FAN)
        levels.append(common.table(gathered(levels[-1]).mapInArrow(multiply, "_row bigint, k int, matrix string"), "products"))
    pair = "array<bigint>"
    states = levels[-1].select("_row", "k", F.array(F.lit(START)).cast(pair).alias("entry"), F.array(F.lit(END)).cast(pair).alias("leave"))
    for below in reversed(levels[:-1]):
        states = gathered(below).join(states, ["_row", "k"]).mapInArrow(divide, "_row bigint, k int, entry array<bigint>, leave array<bigint>")
    traced = long.join(states, ["_row", "k"]).select("doc_id", "_row", "part", "place", "k", "n", "crc", "entry", "leave")
    traced = traced.mapInArrow(back, f"doc_id {kind}, _row bigint, k int, n int, crc bigint, ids array<int>")
    joined = traced.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("c"), F.first("n").alias("n_chunks"), F.first("crc").alias("text_crc32"))
    encoded = joined.select("doc_id", F.flatten("c.ids").alias("ids"), "n_chunks", "text_crc32")
    return done.unionByName(digest(encoded, path, small) if digests else encoded)


def decode(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns and the text of ids; null ids give null."""
    frame = df.select(*keep, "ids")
    fields = {f.name: f for f in frame.schema.fields}
    schema = ", ".join([*(f"`{c}` {fields[c].dataType.simpleString()}" for c in keep), "text string"])

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            out = [None if x.as_py() is None else m.decode(x.as_py()) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(out, pa.string())], [*keep, "text"])

    return frame.mapInArrow(run, schema)


DIGESTS = "n_tokens bigint, n_chunks int, ids_crc32 bigint, round_trip boolean"


def _digested(m: Model, b: pa.RecordBatch) -> pa.RecordBatch:
    lists = b.column(1)
    values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    n, crc, same = [], [], []
    for a, z, want in zip(at[:-1], at[1:], b.column(3).to_pylist(), strict=True):
        ids = values[a:z]
        n.append(int(z - a))
        crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
        text = m.decode_bytes(ids)
        same.append(zlib.crc32(text) == want)
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(2), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "n_chunks", "ids_crc32", "round_trip"])


def digest(df: DataFrame, path: str, small: bool = False) -> DataFrame:
    """(doc_id, n_tokens, n_chunks, ids_crc32, round_trip) of what encode() made; decodes every row's ids."""
    frame = df.select("doc_id", "ids", "n_chunks", "text_crc32")
    kind = frame.schema["doc_id"].dataType.simpleString()

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, small)
        for b in batches:
            yield _digested(m, b)

    return frame.mapInArrow(run, f"doc_id {kind}, {DIGESTS}")
