"""Packing of tokenised documents into training windows by the sum-of-squares rule.

A window is at a *level*, its number of tokens. Each document's rest after its full windows goes whole into the open window
whose move to the next level makes the sum over levels of squared counts of open windows smallest; counts are kept in an array by level.
That keeps levels evenly used, so that most windows get filled exactly. Whenever too many are open, and at the end, the
emptiest ones are cut up to fill the fullest.
"""

import json
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T


PART = 4_000_000  # bytes of text that are encoded together

# The pattern of pre-tokens in the word vocabulary's file, and what it means for words of these characters
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = "^[!-~À-ÖØ-öø-ÿ]*$"
PIECES = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+)"


def _visible() -> dict[int, str]:
    """How byte-level vocabularies write the letters of PLAIN beyond ASCII: bytes that Latin-1 shows stand for themselves, all others
    for characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    own = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(own[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class WordBpe:
    """A tokenizer file whose pre-tokens never cross white space; travels to tasks by value.

    Words between ASCII white space are thus encoded on their own, equal ones once: normalising, splitting and merging see
    the same within a whole text. Words of ASCII and Latin-1 letters and ASCII marks are cut into pre-tokens here, if the file's rules are
    those this was written for, and only their pieces go to the file's merges; all others take the library's whole way.
    Strings of special tokens are ordinary text.
    """

    KEPT, BYTES = 600_000, 32_000_000  # pre-tokens remembered between batches, and what they may take

    def __init__(self, content: str):
        self.content = content

    @classmethod
    def load(cls, path: str) -> "WordBpe":
        with open(path, encoding="utf-8") as file:
            return cls(file.read())

    def __getstate__(self):
        return {"content": self.content}  # tasks build their own tokenizer

    def _build(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.built = Tokenizer.from_str(self.content)
        self.built.encode_special_tokens = True
        rules = json.loads(self.content)
        before, cut = rules["normalizer"] or {}, (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.simple = [n["type"] for n in before.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [
            c.get("type") for c in cut] == ["Split", "ByteLevel"] and cut[0]["pattern"] == {"Regex": PATTERN} and not cut[1]["add_prefix_space"]
        self.visible = _visible()
        # bytes, not lists of numbers: the collector of cycles needn't visit them
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _merged(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens, as 32-bit numbers; the empty one has none."""
        known, merge = self.known, self.built.model.tokenize
        for p in pieces:
            if p not in known:
                ids = merge(p if p.isascii() else p.translate(self.visible)) if p else []
                known[p] = array("I", [t.id for t in ids]).tobytes()
                self.held += len(p) + len(known[p])
        return [known[p] for p in pieces]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids side by side, where each word's begin and the last end) of different words."""
        simple = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False) & self.simple
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(words.filter(pa.array(simple))), PIECES, r"\1 "))
        pieces = parts.flatten().dictionary_encode()
        ids, begins = _taken(*_joined(self._merged(pieces.dictionary.to_pylist())), pieces.indices.to_numpy())
        begins = begins[np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy())))]
        others = self.built.encode_batch(words.filter(pa.array(~simple)).to_pylist(), add_special_tokens=False)
        more, ends = _joined([array("I", e.ids).tobytes() for e in others])
        place = np.where(simple, np.cumsum(simple), simple.sum() + np.cumsum(~simple)) - 1
        return _taken(np.concatenate((ids, more)), np.concatenate((begins, ends[1:] + begins[-1])), place)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each whole text, those of the whole text to the tokenizer; none for null."""
        if "built" not in self.__dict__:
            self._build()
        if len(self.known) > self.KEPT or self.held > self.BYTES:
            self.known, self.held = {}, 0
        words = pc.ascii_split_whitespace(texts.cast(pa.string()))
        flat, counts = words.flatten().dictionary_encode(), pc.fill_null(pc.list_value_length(words), 0).to_numpy()
        ids, begins = _taken(*self._words(flat.dictionary), flat.indices.to_numpy())
        cuts = begins[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, where each part begins and the last ends)."""
    return np.frombuffer(b"".join(parts), np.uint32), np.cumsum([0, *map(len, parts)]) // 4


def _taken(table: np.ndarray, begins: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of ``table`` numbered so, side by side, and where each begins and the last ends."""
    sizes = (begins[1:] - begins[:-1])[number]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return table[np.arange(ends[-1]) + np.repeat(begins[number] - ends[:-1], sizes)], ends


@dataclass
class Piece:
    """Tokens of one document from ``start`` on."""

    doc: object
    start: int
    ids: np.ndarray
    total: int

    def cut(self, length: int) -> tuple["Piece", "Piece"]:
        return Piece(self.doc, self.start, self.ids[:length], self.total), Piece(
            self.doc, self.start + length, self.ids[length:], self.total)


@dataclass
class Window:
    fill: int = 0
    pieces: list[Piece] = field(default_factory=list)

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.fill += len(piece.ids)


class Packer:
    """Open windows by level. ``add`` and ``finish`` return the windows that are done."""

    def __init__(self, size: int = 4096, most_open: int = 1024):
        self.size, self.most_open = size, most_open
        self.counts = np.zeros(size + 1, np.int64)  # open windows at each level; none at 0 and ``size``
        self.at: dict[int, list[Window]] = {}
        self.open = 0

    def level(self, length: int) -> int:
        """The level to place ``length`` tokens at (0: a new window); of equal ones the fullest."""
        last = self.size - length
        # moving a window from level h to h + length changes the squares by 1 - 2 N[h] and 1 + 2 N[h + length]; full ones don't count
        change = 2 * self.counts[length:] + 1
        change[last] = 0
        change[1:] += 1 - 2 * self.counts[1:last + 1]
        change[1:][self.counts[1:last + 1] == 0] = np.iinfo(np.int64).max
        return last - int(change[::-1].argmin())

    def _take(self, level: int) -> Window:
        if level == 0:
            return Window()
        self.counts[level] -= 1
        self.open -= 1
        return self.at[level].pop()

    def _keep(self, window: Window) -> None:
        self.counts[window.fill] += 1
        self.open += 1
        self.at.setdefault(window.fill, []).append(window)

    def add(self, doc: object, ids: np.ndarray) -> list[Window]:
        piece, done = Piece(doc, 0, ids, len(ids)), []
        while len(piece.ids) >= self.size:
            full, piece = piece.cut(self.size)
            done.append(Window(self.size, [full]))
        if len(piece.ids):
            piece.ids = piece.ids.copy()  # not to hold the batch that it came from
            window = self._take(self.level(len(piece.ids)))
            window.add(piece)
            if window.fill == self.size:
                done.append(window)
            else:
                self._keep(window)
                if self.open > self.most_open:
                    done += self._fill_up()
        return done

    def _fill_up(self) -> list[Window]:
        """Fills the fullest windows with what the emptiest hold, whole pieces first; at most one stays open."""
        left = [w for level in sorted(self.at, reverse=True) for w in self.at[level]]
        self.counts[:], self.at, self.open = 0, {}, 0
        done, i, j = [], 0, len(left) - 1
        while i < j:
            room = self.size - left[i].fill
            by = max((k for k, p in enumerate(left[j].pieces) if len(p.ids) <= room), key=lambda k: len(left[j].pieces[k].ids), default=None)
            if by is None:
                kept, moved = left[j].pieces[-1].cut(len(left[j].pieces[-1].ids) - room)
                left[j].pieces[-1] = kept
            else:
                moved = left[j].pieces.pop(by)
            left[j].fill -= len(moved.ids)
            left[i].add(moved)
            if left[i].fill == self.size:
                done.append(left[i])
                i += 1
            if left[j].fill == 0:
                j -= 1
        if i == j and left[i].fill:
            self._keep(left[i])
        return done

    def finish(self) -> list[Window]:
        """All that is open; the last window is cut at powers of two, which need no padding."""
        done = self._fill_up()
        for window in (w for level in self.at.values() for w in level):
            pieces = window.pieces[::-1]
            for bit in range(self.size.bit_length(), -1, -1):
                if not window.fill >> bit & 1:
                    continue
                part = Window()
                while part.fill < 1 << bit:
                    piece, room = pieces.pop(), (1 << bit) - part.fill
                    if len(piece.ids) > room:
                        piece, rest = piece.cut(room)
                        pieces.append(rest)
                    part.add(piece)
                done.append(part)
        self.counts[:], self.at, self.open = 0, {}, 0
        return done


def pack(
    docs: DataFrame, tokenizer: WordBpe, end: int | None = None, size: int = 4096, most_open: int = 1024, id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): a row for each piece of a document in a window of ``size`` tokens.

    A document is its text's ids and ``end``. It is cut only where it passes a full window, where it fills up one that another left, or
    in a partition's last window, which is cut at powers of two; so no window needs padding to ``size`` or to a power of two.
    ``ids`` are little-endian unsigned 32-bit numbers. Windows are filled within a partition of ``docs``, in the order of
    its rows, with at most ``most_open`` open at a time (16 kB each at 4,096 tokens): nothing is shuffled, and a lost task is
    repeated alike if its rows come in the same order, as from files. ``sequence_id`` is unique over all partitions.

    Nulls and empty texts have only ``end`` (without it: no row). Rows are packed one by one: repeated rows and rows without id
    are documents of their own. Other columns are not looked at; an empty table gives no rows.
    """
    given = docs.schema[id_column].dataType
    schema = T.StructType([
        T.StructField("id", given), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    last = np.array([] if end is None else [end], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, kind = Packer(size, most_open), None
        number, rows, held = TaskContext.get().partitionId() << 40, [], 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows))
            kinds = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.name for f in schema])

        def all_windows() -> Iterator[Window]:
            nonlocal kind
            for batch in batches:
                kind = batch.column(0).type
                size_of = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
                # some megabytes of text at a time, or one longer text
                parts = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(size_of) // PART)) + 1, [batch.num_rows]))
                for a, b in zip(parts[:-1].tolist(), parts[1:].tolist()):
                    ids = batch.column(0).slice(a, b - a).to_pylist()
                    for doc, own in zip(ids, tokenizer.encode(batch.column(1).slice(a, b - a))):
                        yield from packer.add(doc, np.concatenate((own, last)))
            yield from packer.finish()

        for window in all_windows():
            offset = 0
            for p in window.pieces:
                n = len(p.ids)
                rows.append((p.doc, p.start, n, p.ids.astype("<u4").tobytes(), p.total, number, offset))
                offset += n
            number += 1
            held += offset
            if held > 1_000_000:
                yield out()
                rows, held = [], 0
        if rows:
            yield out()

    return docs.select(id_column, text).mapInArrow(run, schema)
