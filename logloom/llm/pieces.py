"""SentencePiece merge-type encoding and decoding by backtracking.

The vocabulary comes from a public ``.model`` file.  A text is cut where no piece
can cross (a space after something else, a line end); each part is encoded by
longest matches of an Aho-Corasick automaton, stepping down to shorter matches
when a token does not fit its left neighbour, and back over positions that a
bitfield marks as failed.  Two tokens fit when merging their joined characters
from scratch gives the same two tokens.  Merges look at adjacent symbols only, so
a sequence whose neighbours all fit is the one that merging the whole part gives.
Pieces of spaces alone have equal scores below all others: they are merged last, and a
run of them is covered by longest matches from the left.

The distinct parts of a slice of texts take these steps together, one numpy
operation for all that are still under way; a part too long for that takes them alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from ..session import ship
from . import textkit as tk

SPACE = "▁"
#: Units that step together.
TOGETHER = 1 << 14
#: Pairs that a worker remembers (in a table of four times as many places), those of long parts, and the longest part that steps with others.
PAIRS, LONG_PAIRS, LONGEST = 1 << 19, 50_000, 48
NORMAL, CONTROL, BYTE = 1, 3, 6


class Pieces:
    """A merge-type vocabulary with byte fallback and no normalisation but the leading space."""

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("this encoder is for merge-type models with byte fallback, identity normalisation and a leading space")
        self.text = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.end = trainer.eos_id
        if any(SPACE in p.lstrip(SPACE) or "\n" in p or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in self.id):
            raise ValueError("a piece crosses the cuts between parts")
        #: Neighbouring characters of some piece; a part can be cut between any others.
        self.joined = {piece[i : i + 2] for piece in self.id for i in range(len(piece) - 1)}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if len(piece) > 1:  # a single character always matches
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        #: One number past the pieces: a character in no piece, or nothing at all as left neighbour; neither merges.
        self.none = len(self.text)
        self.width = np.array([*map(len, self.text), 1], np.int32)
        self.single = np.full(0x110000, self.none, np.int32)
        for piece, i in self.id.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
        #: The longest piece that a piece begins with, down to its first character; -1 after that.
        self.shorter = np.full(self.none + 1, -1, np.int32)
        for piece, i in self.id.items():
            if len(piece) > 1:
                self.shorter[i] = next((self.id[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.id), self.none)
        raw = [bytes([int(p[3:-1], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(SPACE, " ").encode() for p, k in zip(self.text, self.kind, strict=True)]
        self.decimal, self.raw = pa.array(list(map(str, range(self.none))), pa.string()), pa.array(raw, pa.binary())
        #: Pieces of a run of spaces: longest matches from the left, none of which needs a second look.
        self.longest = max(len(p) for p in self.id if not p.strip(SPACE))
        self.runs = [self._run(n) for n in range(self.longest)]
        last = min(s for p, s in self.score.items() if p.strip(SPACE))
        if any(s >= last for p, s in self.score.items() if not p.strip(SPACE)) or any(self.merge(SPACE * n) != self._run(n) for n in range(4 * self.longest)):
            raise ValueError("runs of spaces are not merged last, into longest matches")
        self.fits: dict[tuple[str, str], bool] = {}
        self.pairs, self.held = np.full(4 * PAIRS, -1, np.int64), 0

    def _run(self, n: int) -> list[str]:
        out = []
        while n:
            size = next(k for k in range(min(n, self.longest), 0, -1) if SPACE * k in self.id)
            out.append(SPACE * size)
            n -= size
        return out

    def merge(self, text: str) -> list[str]:
        """Best-scored merge first, the leftmost of equals: the definition that ``encode`` must meet."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, left: str, right: str) -> bool:
        return self.merge(left + right) == ([left, right] if left else [right])

    def _remembered_fit(self, left: str, right: str) -> bool:
        if len(self.fits) >= LONG_PAIRS:
            self.fits.clear()
        found = self.fits[left, right] = self._fit(left, right)
        return found

    def split(self, part: str) -> list[str]:
        """The pieces of one part; a character that is in no piece stands alone."""
        n = len(part)
        lengths = [[1] for _ in range(n)]  # a character by itself, in the vocabulary or not
        for end, i in self.automaton.iter(part):
            size = len(self.text[i])
            lengths[end - size + 1].append(size)  # each list grows, as matches come by their ends
        open_at = bytearray(b"\x01") * (n + 1)
        fits, fit = self.fits, self._remembered_fit
        tokens: list[str] = []
        tried: list[int] = []  # index of the length that each token took
        at, left, k = 0, "", len(lengths[0]) - 1 if n else 0
        while at < n:
            sizes = lengths[at]
            while k >= 0:
                size = sizes[k]
                if open_at[at + size]:
                    token = part[at : at + size]
                    good = fits.get((left, token))
                    if good if good is not None else fit(left, token):
                        break
                k -= 1
            if k >= 0:
                tokens.append(token)
                tried.append(k)
                left = token
                at += size
                if at < n:
                    k = len(lengths[at]) - 1
            else:
                open_at[at] = 0
                at -= len(tokens.pop())
                k = tried.pop() - 1
                left = tokens[-1] if tokens else ""
        return tokens

    def ids(self, part: str) -> list[int]:
        tokens = self.split(part)
        out = [self.id.get(token) for token in tokens]
        if None not in out:
            return out
        out = []
        for token in tokens:
            found = self.id.get(token)
            if found is None:
                out += [self.byte[b] for b in token.encode("utf-8", "replace")]
            else:
                out.append(found)
        return out

    def _fitting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs of pieces fit, by a table of pairs seen: twice the pair's number, and one more if it does."""
        keys = left.astype(np.int64) * (self.none + 1) + right
        found = self._look(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            unknown, back = np.unique(keys[new], return_inverse=True)
            text = [*self.text, ""]
            fit = [self._fit(text[key // len(text)], text[key % len(text)]) for key in unknown.tolist()]
            found[new] = np.array(fit, np.int64)[back]
            for a in range(0, len(unknown), PAIRS):
                self._put(2 * unknown[a : a + PAIRS] + fit[a : a + PAIRS])
        return (found & 1).astype(bool)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % len(self.pairs)

    def _look(self, keys: np.ndarray) -> np.ndarray:
        """What the table holds of each pair; -1 if nothing."""
        place = self._place(keys)
        found = self.pairs[place]
        other = np.flatnonzero((found >> 1 != keys) & (found >= 0))
        while len(other):
            place[other] = (place[other] + 1) % len(self.pairs)
            found[other] = self.pairs[place[other]]
            other = other[(found[other] >> 1 != keys[other]) & (found[other] >= 0)]
        return found

    def _put(self, made: np.ndarray) -> None:
        if self.held + len(made) > 2 * PAIRS:
            self.pairs.fill(-1)
            self.held = 0
        self.held += len(made)
        for place, value in zip(self._place(made >> 1).tolist(), made.tolist(), strict=True):
            while self.pairs[place] >= 0:
                place = (place + 1) % len(self.pairs)
            self.pairs[place] = value

    def _together(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): of all units laid end to end, each unit's ids from ``first`` on; by the steps of ``split``."""
        size = pc.utf8_length(units).to_numpy().astype(np.int64)
        start = np.cumsum(size + 1) - size - 1
        text = "\n".join(units.to_pylist()).replace(" ", SPACE)
        letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        longest = self.single[letters]
        matches = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        longest[matches[:, 0] - self.width[matches[:, 1]] + 1] = matches[:, 1]  # of one place, longer ones come later
        open_at = np.ones(len(letters) + 1, bool)
        taken = np.full(len(letters) + 1, -1, np.int32)  # the token from a place on, for places on a unit's path
        before = np.zeros(len(letters) + 1, np.int64)  # where the token left of a place begins
        live = np.flatnonzero(size > 0)
        first, end = start[live], (start + size)[live]
        at, left = first.copy(), np.full(len(live), self.none, np.int32)
        token = longest[at]
        while len(at):
            to = at + self.width[token]
            good = open_at[to]
            asked = np.flatnonzero(good & (token != self.none))
            good[asked] = self._fitting(left[asked], token[asked])
            on, off = np.flatnonzero(good), np.flatnonzero(~good)
            token[off] = self.shorter[token[off]]
            taken[at[on]] = token[on]
            before[to[on]] = at[on]
            at[on], left[on] = to[on], token[on]
            off = off[token[off] < 0]
            while len(off):  # no token is left for this place: back to the one before
                open_at[at[off]] = False
                back = before[at[off]]
                token[off] = self.shorter[taken[back]]
                taken[back] = -1
                at[off] = back
                left[off] = np.where(back == first[off], self.none, taken[before[back]])
                off = off[token[off] < 0]
            rest = at < end
            token[on] = longest[np.minimum(at[on], len(letters) - 1)]
            at, left, token, first, end = (x[rest] for x in (at, left, token, first, end))
        path = np.flatnonzero(taken >= 0)
        ids = taken[path]
        count = np.ones(len(ids), np.int64)
        strange = np.flatnonzero(ids == self.none)
        if len(strange):  # characters in no piece: one id for each byte
            chars, which = np.unique(letters[path[strange]], return_inverse=True)
            encoded = [[self.byte[b] for b in chr(c).encode()] for c in chars.tolist()]
            count[strange] = np.array([len(e) for e in encoded])[which]
            ids = np.repeat(ids, count)
            ids[ids == self.none] = np.fromiter(chain.from_iterable(encoded[w] for w in which.tolist()), np.int32)
        return ids, np.concatenate([[0], np.cumsum(count)])[np.searchsorted(path, np.append(start, len(letters) + 1))]

    def _units(self, part: str) -> tuple[int, list[str]]:
        """A part that begins with several spaces or is long: spaces before its word, and the word in units that no piece crosses."""
        word = part.lstrip(" ")
        run = len(part) - len(word)
        if not word:
            return run, []
        if run:
            run, word = run - 1, SPACE + word
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.joined] if len(word) > LONGEST else []
        return run, [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def _spaced(self, run: int, ids: list[int]) -> list[int]:
        """A run of spaces before the ids of a word, whose own space joins the run if no piece of the word takes it."""
        if run and ids[:1] == [self.id[SPACE]]:
            run, ids = run + 1, ids[1:]
        return [self.id[SPACE * self.longest]] * (run // self.longest) + [self.id[t] for t in self.runs[run % self.longest]] + ids

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, row): the ids of each part are those from ``first[row]`` up to the next."""
        apart = pc.or_(pc.starts_with(parts, "  "), pc.greater(pc.utf8_length(parts), LONGEST))
        plain, others = parts.filter(pc.invert(apart)), [self._units(p) for p in parts.filter(apart).to_pylist()]
        known = {u: i for i, u in enumerate(dict.fromkeys(u for _, units in others for u in units if len(u) <= LONGEST), len(plain))}
        units = pa.concat_arrays([plain, pa.array(list(known), pa.string())])
        made = [self._together(units.slice(a, TOGETHER)) for a in range(0, len(units), TOGETHER)]
        ids = np.concatenate([np.zeros(0, np.int32), *(m[0] for m in made)])
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(m[1]) for m in made)]))])
        row = np.empty(len(parts), np.int64)
        mask = apart.to_numpy(zero_copy_only=False)
        row[~mask], row[mask] = np.arange(len(plain)), len(first) - 1 + np.arange(len(others))
        made = []
        for run, units in others:
            of = [ids[first[known[u]] : first[known[u] + 1]].tolist() if u in known else self.ids(u) for u in units]
            made.append(self._spaced(run, list(chain.from_iterable(of))))
        more = np.cumsum([len(m) for m in made], dtype=np.int64) + first[-1]
        return np.concatenate([ids, np.fromiter(chain.from_iterable(made), np.int32)]), np.concatenate([first, more]), row

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(number of ids, decimal ids with the end id and one space between, the text decoded from them) of each text."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")  # to the vocabulary they are one
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        ((_, _, data, offsets),) = tk.slices(texts, texts.nbytes + 1)
        gap, line = data == 32, data == 10
        begins = line | gap
        begins[1:] &= ~(gap[1:] & gap[:-1])
        begins[1:] |= line[:-1]
        begins[offsets[offsets < len(data)]] = True
        begins = np.flatnonzero(begins)
        parts = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data)).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        ids, first, row = self._parts(parts.dictionary)
        ids, first = np.append(ids, np.int32(self.end)), np.append(first, len(ids) + 1)  # the last row: the end id alone
        upto = np.searchsorted(begins, offsets)
        rows = np.insert(row[parts.indices.to_numpy()], upto[1:], len(first) - 2)
        upto += np.arange(len(upto))
        counts = np.concatenate([[0], np.cumsum(np.diff(first)[rows])])
        joined = [
            pc.binary_join(pa.ListArray.from_arrays(upto.astype(np.int32), pc.binary_join(pa.ListArray.from_arrays(first.astype(np.int32), values.take(pa.array(ids))), between).take(pa.array(rows))), between)
            for values, between in ((self.decimal, " "), (self.raw, b""))
        ]
        return counts[upto[1:]] - counts[upto[:-1]], joined[0], pc.utf8_slice_codeunits(joined[1].cast(pa.string()), 1)

    def encode(self, text: str) -> tuple[str, str]:
        """(decimal ids with the end id, one space between; the text decoded from them)."""
        _, ids, decoded = self.encode_all(pa.array([text], pa.string()))
        return ids[0].as_py(), decoded[0].as_py()


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    return Pieces(path)


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b, _, _ in tk.slices(texts):
                counts, made, decoded = pieces.encode_all(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), pa.array(counts, pa.int64()), made, decoded], names=["id", "n_tokens", "ids", "decoded"])
        tk.give_back()

    return run


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids, decoded) for every row, over its whole text.

    ``model`` is the path of a merge-type ``.model`` file that every executor can
    read.  ``ids`` has the token ids in decimal, one space between them and the end
    id last (``id_array`` turns them into an array); ``decoded`` is the text made
    from them again.  A null or empty text has the end id alone.  Repeated rows
    stay, other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encoder(model), "id long, n_tokens long, ids string, decoded string").withColumnRenamed("id", id_col)


def id_array(ids: Column) -> Column:
    return F.split(ids, " ").cast("array<int>")
