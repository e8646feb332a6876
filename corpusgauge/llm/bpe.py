"""Byte-pair encoding with a public vocabulary: pieces, tree concatenation of long texts, and decoding.

A text is cut where every encoder must cut it as well: before a single space between two visible characters.
The ids of such pieces do not depend on their neighbours, so a worker keeps the ids of the pieces it has met.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters of a leaf of the tree; longer texts are cut into leaves that are encoded in parallel.
LEAF_CHARS = 16_384
#: Pieces whose ids a worker keeps, per vocabulary and lead; beyond it the memory starts anew. About 20 MB.
KEPT_PIECES = 100_000
#: Bytes on either side of a join in the first window; later windows are four times as wide each.
FIRST_WINDOW = 32

#: White space by Python's and by Unicode's rule.
_BLANK = re.compile(r"\s")
#: Marks that stand apart from the letters before them.
_ENDS = frozenset(".,;:!?")
#: Where a word vocabulary that drops white space may be cut.
_ASCII_BLANK = re.compile(r"[\x20\t\n\r]+")


#: How public vocabularies cut text. The first takes the space before a word along, the second drops blanks and marks a word's end.
_SPACED_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENDED_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The second cut for the characters below, in this language's own patterns.
_ENDED_WORDS = re.compile("[a-zA-Zªµº\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\s0-9a-zA-Zªµº\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: What every version of Unicode may not cut, compose or lower-case alike: controls, unusual blanks, numbers that are no digits, and all beyond Latin letters.
_UNSETTLED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\xad\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")
#: A byte that stands for the mark of a word's end, and one to keep a token's merges from being passed over in the check of them.
_WORD_END, _BEHIND = b"\x01", b"\xfe"


class Merges:
    """Ids of whole texts of settled characters, by the merges of a vocabulary file.

    The merges run in another public library, which takes them as a table from bytes to ids, of which the smaller merges first.
    A mark of a word's end is a byte of its own there, merged before all else.
    """

    def __init__(self, model: dict, lower: bool):
        import tiktoken

        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        of = {c: b for b, c in byte_letters().items()}
        merged = [vocab["".join(x.split(" ")) if isinstance(x, str) else "".join(x)] for x in model["merges"]]
        if any(x >= y for x, y in zip(merged, merged[1:], strict=False)) or len(vocab) - len(merged) != (512 if suffix else 256) or merged[0] != len(vocab) - len(merged):
            raise ValueError("ids don't follow the order of the merges")

        def raw(token: str) -> bytes:
            ends = suffix and token.endswith(suffix) and token != suffix
            return bytes(of[c] for c in (token[: -len(suffix)] if ends else token)) + (_WORD_END if ends else b"")

        table = {raw(t): i for t, i in vocab.items()}
        self.core = tiktoken.Encoding("own", pat_str=r"[^\x01]+\x01" if suffix else _SPACED_CUT, mergeable_ranks=table, special_tokens={})._core_bpe
        # a token that its own merges don't lead to would be taken whole
        own = [t for t in table if t[-1:] != _BEHIND]
        if len(table) != len(vocab) or any(self.core.encode_single_piece(t + _BEHIND)[:-1] != [table[t]] for t in own if len(t) > 2 or not suffix):
            raise ValueError("a token is not what its merges give")
        self.ended, self.lower = bool(suffix), lower

    @classmethod
    def of_file(cls, path: str) -> Merges | None:
        """None where a vocabulary works in another way."""
        with open(path) as f:
            whole = json.load(f)
        model, cuts, norm = whole["model"], whole["pre_tokenizer"] or {}, whole["normalizer"]
        changes = norm["normalizers"] if norm and norm["type"] == "Sequence" else [norm] if norm else []
        kinds = [x["type"] for x in changes]
        if model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
            return None
        if model["end_of_word_suffix"]:
            steps = cuts.get("pretokenizers", [{}, {}])
            known = len(steps) == 2 and {"type": "Split", "pattern": {"Regex": _ENDED_CUT}, "behavior": "Removed", "invert": True}.items() <= steps[0].items()
            known = known and {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}.items() <= steps[1].items()
            known = known and set(kinds) <= {"NFC", "Replace", "Lowercase"} and all(x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in changes if x["type"] == "Replace")
        else:
            known = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items() <= cuts.items() and not changes
        try:
            return cls(model, "Lowercase" in kinds) if known else None
        except (KeyError, ValueError):
            return None

    def __call__(self, text: str) -> bytes | None:
        """Ids of a text; None if it holds other characters."""
        if _UNSETTLED.search(text):
            return None
        if self.ended:
            low = text.lower() if self.lower else text
            if not low.isascii() and _UNSETTLED.search(low):  # small letters may lie elsewhere
                return None
            pieces = _ENDED_WORDS.findall(low)
            text = "\x01".join(pieces) + "\x01" if pieces else ""
        return array("I", self.core.encode_ordinary(text)).tobytes()


class Pieces(dict):
    """Ids of pieces as bytes; unknown ones are asked of the library when they are first looked up."""

    def __init__(self, library, lead: str):
        self.library, self.lead, self.marks, self.normalizer = library, lead, {}, library.normalizer
        self.line_end = library.encode("\n", add_special_tokens=False).ids

    def _parts(self, piece: str) -> bool:
        """Whether a piece is letters and a mark with ids of their own. A normalizer may end letters in a combining mark, which joins it."""
        if piece[-1:] not in _ENDS or not (word := piece[:-1]).isalpha():
            return False
        return self.normalizer is None or word.isascii() or self.normalizer.normalize_str(word).isalpha()

    def __missing__(self, piece: str) -> bytes:
        if self._parts(piece):
            if (mark := self.marks.get(piece[-1])) is None:
                mark = self.marks[piece[-1]] = self._asked(piece[-1])
            ids = self[piece[:-1]] + mark
        else:
            ids = self._asked(self.lead + piece)
        self[piece] = ids
        return ids

    def learn(self, words: set[str]) -> None:
        """Asks the library for all new ones of some words without white space at once.

        Single line ends stand between the words: each is one id of its own and changes no word beside it. Where a
        vocabulary drops white space, or the ids do not fall apart into as many words, nothing is learned here.
        """
        new = {w[:-1] if self._parts(w) else w for w in words if w not in self}
        new = [w for w in new if w not in self]
        if len(new) < 2 or len(self.line_end) != 1:
            return
        ids = np.array(self.library.encode_batch_fast(["\n".join([self.lead + w for w in new])], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == self.line_end[0])
        if len(ends) != len(new) - 1:
            return
        data = ids.tobytes()
        starts, stops = [0, *(4 * ends + 4).tolist()], [*(4 * ends).tolist(), len(data)]
        self.update(zip(new, [data[a:b] for a, b in zip(starts, stops, strict=True)], strict=True))

    def _asked(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to the tokenizers library's for the whole text."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kept = kept
        self.path = path
        self.memory = {lead: Pieces(self.library, lead) for lead in ("", " ")}
        added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        self.keeps_space = self.library.normalizer is None
        self.size = self.library.get_vocab_size(with_added_tokens=True)

    @cached_property
    def merges(self) -> Merges | None:
        """Made when the first text is encoded: a worker that only decodes needs none."""
        return Merges.of_file(self.path)

    @property
    def kind(self) -> str:
        """The narrowest number that holds every id."""
        return "<u2" if self.size <= 1 << 16 else "<u4"

    def whole(self, text: str) -> bytes:
        """The library's own ids of a text."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        """Pieces whose ids, one after the other, are the ids of the text."""
        if self.added and ("<" in text) and self.added.search(text):
            return [text]
        if not self.keeps_space:
            return _ASCII_BLANK.split(text)
        parts = text.split(" ")
        if len(parts) == 1:
            return parts
        # a cut stands only between two visible characters; other parts are glued together again
        if "" in parts or _BLANK.search(text.replace(" ", "")):
            glued, last = [parts[0]], parts[0]
            for part in parts[1:]:
                if last and part and not last[-1].isspace() and not part[0].isspace():
                    glued.append(" " + part)
                else:
                    glued[-1] += " " + part
                last = part
            return [x for piece in glued for x in self._lines(piece)]
        return [parts[0], *[" " + x for x in parts[1:]]]

    @staticmethod
    def _lines(piece: str) -> list[str]:
        """A piece, cut around single line ends between two visible characters."""
        if "\n" not in piece:
            return [piece]
        parts = piece.split("\n")
        out, last = [parts[0]], parts[0]
        for part in parts[1:]:
            if last and part and not last[-1].isspace() and not part[0].isspace():
                out += ["\n", part]
            else:
                out[-1] += "\n" + part
            last = part
        return out

    def _known(self, words: list[str], lead: str = "") -> bytes:
        """Ids of pieces that all begin with `lead`."""
        memory = self.memory[lead]
        if len(memory) > self.kept:
            memory.clear()
        return b"".join(map(memory.__getitem__, words))

    def _learned(self, words: list[str], lead: str = "") -> bytes:
        """As _known, for words without white space: new ones are learned together."""
        self.memory[lead].learn(set(words))
        return self._known(words, lead)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text: by the merges alone if they can, else by its pieces. Where each blank is one space or line end between visible characters, words are looked up at once."""
        special = self.added and "<" in text and self.added.search(text)
        if not special and self.merges and (ids := self.merges(text)) is not None:
            return ids
        words = text.split()
        if special or " ".join(words) != text.replace("\n", " "):
            return self._known(self.pieces(text))
        if not self.keeps_space:
            return self._known(words)
        if "\n" not in text:
            return self._known(words[:1]) + self._learned(words[1:], " ")
        lines = [line.split(" ") for line in text.split("\n")]
        self.memory[""].learn({x[0] for x in lines})
        self.memory[" "].learn({w for x in lines for w in x[1:]})
        return self._known(["\n"]).join(self._known(x[:1]) + self._known(x[1:], " ") for x in lines)

    @lru_cache(maxsize=1)  # noqa: B019
    def token_bytes(self) -> list[bytes]:
        """The bytes that each id stands for, for a byte-level vocabulary."""
        of = {c: b for b, c in byte_letters().items()}
        out = []
        for i in range(self.size):
            token = self.library.id_to_token(i) or ""
            out.append(bytes(of[c] for c in token) if all(c in of for c in token) else token.encode())
        return out

    @lru_cache(maxsize=1)  # noqa: B019
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes in a row, where each starts, and how long each is."""
        each = self.token_bytes()
        sizes = np.array([len(x) for x in each], dtype=np.int64)
        return np.frombuffer(b"".join(each), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for; an id outside the vocabulary stands for none."""
        flat, starts, sizes = self.tables()
        ids = ids[ids < self.size]
        n = sizes[ids]
        if not len(n):
            return b""
        at = np.repeat(starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return flat[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 stands for itself, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a vocabulary file."""
    return PieceEncoder(path)


def _safe_cuts(data: bytes) -> np.ndarray:
    """Offsets of single spaces between two visible ASCII characters."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    seen = (b > 32) & (b < 127)
    return np.flatnonzero((b[1:-1] == 32) & seen[:-2] & seen[2:]) + 1


def join_pair(enc: PieceEncoder, left: tuple[bytes, np.ndarray], right: tuple[bytes, np.ndarray]) -> tuple[bytes, np.ndarray]:
    """Ids of two neighbouring parts of a text from the ids of each.

    The text around the join is encoded again in growing windows. A window is accepted if both its ends are places
    where the part beside it agrees: a cut that every encoding has, or, inside one unbroken run of letters, a token
    that the window and the part have in common (ids are right as soon as each two neighbours are). Without such
    places the window grows until it holds both parts whole.
    """
    (a_text, a), (b_text, b) = left, right
    if not a_text or not b_text:
        return a_text + b_text, np.concatenate([a, b])
    text = a_text + b_text
    sizes = enc.tables()[2]
    a_ends, b_ends = np.cumsum(sizes[a]), np.cumsum(sizes[b])
    exact = a_ends[-1] == len(a_text) and b_ends[-1] == len(b_text)
    a_starts, b_starts = a_ends - sizes[a], b_ends - sizes[b]
    width = FIRST_WINDOW
    while exact and (width < len(a_text) or width < len(b_text)):
        near_a, near_b = a_text[-width:], b_text[:width]
        cuts_a, cuts_b = _safe_cuts(near_a), _safe_cuts(near_b)
        if len(cuts_a) and len(cuts_b):
            x, y = max(0, len(a_text) - width) + int(cuts_a[0]), int(cuts_b[-1])
            i, j = np.searchsorted(a_starts, x), np.searchsorted(b_starts, y)
            # a vocabulary may split bytes of a character, never a cut
            if a_starts[i] == x and b_starts[j] == y:
                mid = np.frombuffer(enc.encode(text[x : len(a_text) + y].decode()), "<u4")
                return text, np.concatenate([a[:i], mid, b[j:]])
        i, j = np.searchsorted(a_starts, len(a_text) - width), np.searchsorted(b_ends, width, "right") - 1
        if i < len(a) and j >= 0:
            x, y = int(a_starts[i]), len(a_text) + int(b_ends[j])
            try:
                inner = text[max(0, x - 12) : y].decode()
                window = text[x:y].decode()
            except UnicodeDecodeError:
                inner, window = " ", ""
            if inner.isalpha() and x >= 12:
                mid = np.frombuffer(enc.whole(window), "<u4")
                if len(mid) > 1 and mid[0] == a[i] and mid[-1] == b[j]:
                    return text, np.concatenate([a[:i], mid, b[j + 1 :]])
        width *= 4
    return text, np.frombuffer(enc.encode(text.decode()), "<u4")


def join_tree(enc: PieceEncoder, parts: list[tuple[bytes, np.ndarray]]) -> np.ndarray:
    """Ids of a text from the ids of its leaves, joined two by two, level by level."""
    if not parts:
        return np.zeros(0, "<u4")
    while len(parts) > 1:
        joined = [join_pair(enc, x, y) for x, y in zip(parts[::2], parts[1::2], strict=False)]
        parts = joined + parts[len(joined) * 2 :]
    return parts[0][1]


def whole_text_ids(path: str, texts: Iterable[str | None]) -> Iterator[bytes]:
    """Ids of each whole text as bytes; null: none."""
    enc = encoder(path)
    for text in texts:
        yield enc.encode(text) if text else b""


def encode(df: DataFrame, text: str, path: str, out: str = "ids", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Adds the ids of every whole text as binary: little-endian unsigned 32-bit, none for null and empty texts.

    Texts of at most `leaf_chars` characters are encoded where they stand. Longer ones are cut into leaves, rows of their
    own that any task may encode, and joined again by their digest; equal texts are encoded once. A text itself,
    being one value, fits a task. All columns and rows stay, repeated ones too; row order is free.
    """
    if out in df.columns:
        raise ValueError(f"the table has a column {out} already")
    long = F.coalesce(F.char_length(text) > leaf_chars, F.lit(False))
    fields = [*df.schema.fields, T.StructField(out, T.BinaryType())]

    def short_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            ids = pa.array(whole_text_ids(path, (x.as_py() for x in texts)), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, out])

    short = df.where(~long).mapInArrow(short_ids, T.StructType(fields))
    n = F.ceil(F.char_length("_text") / leaf_chars).cast("int")
    parts = df.where(long).select(F.sha2(F.col(text), 256).alias("_digest"), F.col(text).alias("_text")).select(
        "_digest", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
            i.alias("at"), F.substring(F.col("_text"), i * leaf_chars + 1, F.lit(leaf_chars)).alias("part")))).alias("_leaf"),
    )
    # copies of a text fold before the shuffle that deals the leaves
    leaves = parts.groupBy("_digest", F.col("_leaf.at").alias("at")).agg(F.min("_leaf.part").alias("part"))

    def leaf_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids, kept = [], []
            for text_ in b.column(2).to_pylist():
                found = np.frombuffer(enc.encode(text_), "<u4")
                ids.append(found.astype(enc.kind).tobytes())
                # ids that stand for the part's own bytes are enough to have it back
                kept.append(None if enc.decode_bytes(found) == (raw := text_.encode()) else raw)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept, pa.binary()), pa.array(ids, pa.binary())], ["_digest", "at", "part", "leaf_ids"])

    encoded = leaves.mapInArrow(leaf_ids, "_digest string, at int, part binary, leaf_ids binary")

    def joined(group: pa.Table) -> pa.Table:
        enc, group = encoder(path), group.sort_by("at")
        each = [(x.as_py(), np.frombuffer(y.as_py(), enc.kind).astype("<u4")) for x, y in zip(group.column("part"), group.column("leaf_ids"), strict=True)]
        ids = join_tree(enc, [(enc.decode_bytes(y) if x is None else x, y) for x, y in each])
        return pa.table({"_digest": group.column("_digest")[:1], "_ids": pa.array([ids.astype("<u4").tobytes()], pa.binary())})

    trees = encoded.groupBy("_digest").applyInArrow(joined, "_digest string, _ids binary")
    digest = F.sha2(F.col(text), 256)
    rest = df.where(long).withColumn("_digest", digest).join(trees, "_digest", "left").select(*df.columns, F.col("_ids").alias(out))
    return short.unionByName(rest)


def decode(df: DataFrame, ids: str, path: str, out: str = "decoded") -> DataFrame:
    """Adds the text of binary ids as encode() writes them; null ids: null, no ids: empty."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            found = [None if x is None else enc.decode(np.frombuffer(x, "<u4")) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, out])

    return df.mapInArrow(texts, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def n_ids(ids: Column) -> Column:
    """How many ids a binary holds."""
    return (F.octet_length(ids) / 4).cast("long")
