"""SentencePiece encoding and decoding of merge-type models (operator 11).

A merge-type model merges, of all neighbouring symbols whose concatenation is a piece, the pair of the best score, the leftmost
of equal ones, until none is left. Two facts make one pass enough. First, where a text ends in some symbol t, what stands before t is
merged as if it stood alone; so every prefix has one last piece, and the pieces of a text are found backwards from the
last pieces of its prefixes. Second, pieces a and b stand side by side exactly if merging the text ab gives a and b again. So
the last piece of a prefix is the only piece ending there, as an automaton over all pieces finds them, that is compatible
with the last piece of the prefix before it.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kestrel.llm.common import with_columns_in_arrow

#: Fixed value of the file format: the letter that stands for a blank.
BLANK = "▁"
#: Rank of what is not a piece.
NONE = 1 << 60
ID = struct.Struct("<i")
#: Entries after which a worker's memory of pairs or of words starts anew, and the letters up to which a word is remembered.
REMEMBERED, WORD = 600_000, 48
#: Seams that pieces may hold between letters, digits and signs; texts with one of them are cut at blanks only.
ODD = 64


class Known(dict):
    """Words and what ``make`` gave for them, up to REMEMBERED; longer ones are made each time."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str) -> bytes:
        made = self.make(word)
        if len(word) <= WORD:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = made
        return made


class Model:
    """The pieces of a model file, and both directions."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as format_

        held = format_.ModelProto()
        with open(path, "rb") as f:
            held.ParseFromString(f.read())
        spec, kinds = held.normalizer_spec, format_.ModelProto.SentencePiece
        if held.trainer_spec.model_type != format_.TrainerSpec.BPE:
            raise ValueError("not a model of merge type")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or held.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a model that changes letters or drops white space before it merges")
        if held.denormalizer_spec.precompiled_charsmap:
            raise ValueError("a model that changes letters after decoding")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in held.pieces):
            raise ValueError("a model with pieces that are set by hand or not in use")
        self.prefix = BLANK if spec.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(held.pieces) if p.type == kinds.NORMAL}
        scores = {s: r for r, s in enumerate(sorted({held.pieces[i].score for i in self.ids.values()}, reverse=True))}
        self.rank = {piece: scores[held.pieces[i].score] for piece, i in self.ids.items()}
        byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(held.pieces) if p.type == kinds.BYTE}
        self.bytes = [byte_ids[b] for b in range(256)] if held.trainer_spec.byte_fallback else None
        self.unknown = next(i for i, p in enumerate(held.pieces) if p.type == kinds.UNKNOWN)
        surface = [p.piece.replace(BLANK, " ").encode() if p.type == kinds.NORMAL else b"" for p in held.pieces]
        surface[self.unknown] = held.trainer_spec.unk_surface.encode()
        self.blank_first = {i for piece, i in self.ids.items() if piece.startswith(BLANK)} if spec.add_dummy_prefix else set()
        for b, i in byte_ids.items():
            surface[i] = bytes([b])
        self.nothing = len(surface)  # stands for a null id
        self.surface = pa.array([*surface, b""], pa.large_binary())
        self.control = np.array([self.nothing, *(i for i, p in enumerate(held.pieces) if p.type == kinds.CONTROL)])
        self.packed = {piece: ID.pack(i) for piece, i in self.ids.items()}
        # Nothing merges across a seam that no piece holds: words are cut before their blanks and, finer, between letters, digits and signs.
        cut = not any(BLANK in piece.lstrip(BLANK) for piece in self.ids)
        self.coarse = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+" if cut else "(?s).+")
        self.fine = re.compile(rf"{BLANK}*(?:[^\W\d_]+|(?:[^\w{BLANK}]|_)+)|\d|{BLANK}+")
        held_seams = {a[-1] + b[0] for piece in self.ids for own in [self.fine.findall(piece)] for a, b in zip(own, own[1:])}
        self.odd = re.compile("|".join(map(re.escape, sorted(held_seams))) or "(?!)") if len(held_seams) <= ODD else re.compile("")
        self.made: dict[str, list | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known = Known(self.word)
        self.letters: dict[str, str] = {}
        self.ends = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1 and self.merges(piece) is not None:
                self.ends.add_word(piece, piece)
        self.ends.make_automaton()

    def merges(self, piece: str) -> list[tuple[int, str, str]] | None:
        """How ``piece`` comes about, in order: (rank, first symbol, last symbol) after each merge; None if merging its letters ends elsewhere."""
        if piece not in self.made:
            parts, done = list(piece), []
            while len(parts) > 1:
                rank, i = min((self.rank.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == NONE:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                done.append((rank, parts[0], parts[-1]))
            self.made[piece] = done if len(parts) == 1 else None
        return self.made[piece]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the letters of ``a`` and ``b`` gives these two again. Both come about as if alone unless the pair of
        symbols at the seam is better than the next merge inside; of equal merges the left one comes first."""
        one, two = self.merges(a), self.merges(b)
        i, j, right, left = 0, 0, a[-1], b[0]
        while True:
            x = one[i][0] if i < len(one) else NONE
            y = two[j][0] if j < len(two) else NONE
            seam = self.rank.get(right + left, NONE)
            if seam < x and seam <= y and seam != NONE:
                return False
            if x == y == NONE:
                return True
            if x <= y:
                right = one[i][2]
                i += 1
            else:
                left = two[j][1]
                j += 1

    def last_pieces(self, text: str) -> list[str]:
        """The last piece of every prefix of ``text`` but the empty one. A letter where no longer piece fits is a symbol of its own."""
        last = [self.letters.setdefault(x, x) for x in text] if len(text) > WORD else list(text)
        pairs, done = self.pairs, -1
        for end, piece in self.ends.iter(text):
            if end == done:
                continue
            before = end - len(piece)
            fits = before < 0
            if not fits:
                pair = (last[before], piece)
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= REMEMBERED:
                        pairs.clear()
                    fits = pairs[pair] = self.compatible(*pair)
            if fits:
                last[end], done = piece, end
        return last

    def word(self, text: str) -> bytes:
        """The ids of ``text`` (little-endian 32 bits each), which nothing merges across, read backwards from the last pieces of its prefixes."""
        last, at, pieces = self.last_pieces(text), len(text), []
        while at:
            pieces.append(last[at - 1])
            at -= len(pieces[-1])
        pieces.reverse()
        return b"".join([self.packed.get(p) or self.unheld(p) for p in pieces])

    def unheld(self, letter: str) -> bytes:
        """The ids of a letter that is not a piece: its bytes', or the unknown one."""
        ids = [self.bytes[b] for b in letter.encode()] if self.bytes else [self.unknown]
        return b"".join(ID.pack(i) for i in ids)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        text = self.prefix + text.replace(" ", BLANK)
        words = self.coarse if self.odd.search(text) else self.fine
        return np.frombuffer(b"".join(map(self.known.__getitem__, words.findall(text))), "<i4")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ``ids``: control ids give nothing, the blank that starts a text was added and goes, bytes that are no letter
        become U+FFFD each. Ids outside the model are an error."""
        flat = np.fromiter(ids, np.int64)
        return self.decode_all(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat)))[0]

    def decode_all(self, lists: pa.ListArray) -> list[str]:
        """The text of each list. The bytes of all ids are laid side by side at once, and cut where the lists end."""
        lists = lists.cast(pa.large_list(pa.int64()))
        given = lists.flatten().drop_null().to_numpy()
        if len(given) and not 0 <= given.min() <= given.max() < self.nothing:
            raise IndexError("an id outside the model")
        flat, ends = lists.flatten().fill_null(self.nothing), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
        ids = flat.to_numpy()
        ids = ids[~np.isin(ids, self.control)] if len(self.control) else ids
        if len(ids) < len(flat):
            kept = np.concatenate([[0], np.cumsum(~np.isin(flat.to_numpy(), self.control))])
            ends = kept[ends]
        laid = self.surface.take(pa.array(ids))
        at = np.frombuffer(laid.buffers()[1], np.int64)[laid.offset : laid.offset + len(laid) + 1] if len(ids) else np.zeros(1, np.int64)
        data = memoryview(laid.buffers()[2]) if len(ids) and laid.buffers()[2] else memoryview(b"")
        out, start = [], 0
        for end in ends.tolist():
            skip = 1 if end > start and ids[start] in self.blank_first else 0
            own = bytes(data[at[start] + skip : at[end]])
            try:
                out.append(own.decode())
            except UnicodeDecodeError:
                out.append("".join(self._by_byte(own)))
            start = end
        return out

    @staticmethod
    def _by_byte(data: bytes) -> Iterable[str]:
        at = 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    yield data[at : at + n].decode()
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                yield "�"
                at += 1


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """The model at ``path``, read once a worker."""
    return Model(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append ``ids`` (array of int): the ids of every whole text, without begin and end ids.

    Null text counts as empty and has no ids; an empty table gives an empty table; repeated rows are encoded alike; an input column
    named like ``ids`` is replaced. No shuffle; a worker remembers up to REMEMBERED words and pairs, so its memory is
    bounded but for the longest text, which takes about eight bytes a letter of its longest word.
    """

    def start():
        held = model(path)

        def step(texts):
            return [[held.encode(t or "") for t in texts]]

        return step

    return with_columns_in_arrow(docs, [text], [T.StructField(ids, T.ArrayType(T.IntegerType()))], start)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Append ``text``: what the array of ids stands for. Null counts as no ids and gives an empty text; null ids are skipped."""

    def start():
        held = model(path)

        def step(lists):
            return [held.decode_all(lists)]

        return step

    return with_columns_in_arrow(docs, [ids], [T.StructField(text, T.StringType())], start, listed=False)
