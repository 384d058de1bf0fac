"""SentencePiece BPE encoding with a table of last tokens per prefix, and decoding.

BPE gives every prefix of a text one encoding, so one last token. The last token of a prefix is
found from those of shorter prefixes: of the pieces that end there (matches of an automaton over
the vocabulary) exactly one may follow the last token of the prefix before it. Two pieces are
compatible when BPE leaves them as they are side by side. Ids are then read backwards along the
table. Pieces never cross from other characters into a word-start mark, so a text is cut there
and equal words are encoded once per task.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "▁"
#: Words that a task keeps; the table is emptied when full, so its size stays bounded.
CACHE_WORDS = 100_000
CACHE_PAIRS = 200_000
#: Longer words are encoded but not kept.
CACHE_CHARS = 64


def _parts(pieces: dict[str, int]) -> re.Pattern:
    """A pattern whose matches cut a text where no piece crosses, so no merge does.

    Letters are one kind of character, others a second, the word-start mark a third. Where a
    piece joins two kinds in some order, texts are not cut between these kinds.
    """

    def kind(c: str) -> str:
        return "m" if c == MARK else "w" if c.isalpha() else "o"

    joined = {kind(a) + kind(b) for p in pieces for a, b in zip(p, p[1:])}
    letters, other = r"[^\W\d_]", rf"(?:(?!{MARK})[\W\d_])"
    if joined & {"wm", "om"}:
        return re.compile(r"(?s:.+)")
    if joined & {"wo", "ow"}:
        return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
    mark = f"{MARK}*" if "mw" in joined else ""
    mark_other = f"{MARK}*" if "mo" in joined else ""
    return re.compile(f"{mark}{letters}+|{mark_other}{other}+|{MARK}+")


class PrefixTable:
    """Encoder and decoder of one BPE model with identity normalisation and byte fallback."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = {}
        scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.silent = set()
        self.lengths = [len(p) for p in self.pieces]
        self.names = [str(i) for i in range(size)]
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif model.is_control(i):
                self.silent.add(i)
            elif not (model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                scores[piece] = model.get_score(i)
        self.unknown = model.unk_id()
        self.values = {i: v for v, i in self.byte_ids.items()}
        self.plain = [p.replace(MARK, " ") for p in self.pieces]
        if self.unknown >= 0:
            self.plain[self.unknown] = " ⁇ "
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        if {c for p in self.ids for c in p} - self.ids.keys():
            raise ValueError("a character of a piece is no piece itself")
        self.part = _parts(self.ids)
        ranks = {score: n for n, score in enumerate(sorted(set(scores.values()), reverse=True))}
        #: When BPE merges a pair into this piece: 0 first, equal for equal scores.
        self.order = {piece: ranks[score] for piece, score in scores.items()}
        self.halves = {p: h for p in self.ids if len(p) > 1 and (h := self._halves(p))}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1 or piece in self.halves:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts that BPE merges last to make ``piece``; None if it never makes it."""
        parts = list(piece)
        while len(parts) > 1:
            pairs = [self.order.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((o for o in pairs if o is not None), default=None)
            if best is None:
                return None
            at = pairs.index(best)
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return None

    def _pair(self, left: str, right: str) -> bool:
        """Whether ``right`` may follow ``left``: BPE leaves the two as they are side by side.

        Undoes the merges inside both, latest first. At each state the inner ends of the two
        must not be a pair that BPE would have merged before the merge just undone.
        """
        order, halves, limit = self.order, self.halves, len(self.pieces)
        while True:
            across = order.get(left + right)
            if across is not None and across < limit:
                return False
            at_left = order[left] if left in halves else -1
            at_right = order[right] if right in halves else -1
            if at_left > at_right:  # of equal merges the one further left comes first
                limit, left = at_left, halves[left][1]
            elif at_right >= 0:
                limit, right = at_right + 1, halves[right][0]
            else:
                return True

    def _encode(self, word: str) -> tuple[int, ...]:
        """Fills the table of last tokens from left to right and reads the ids backwards."""
        compatible, unset = self.compatible, -1
        last = [unset] * len(word)
        # The automaton gives the pieces that end at a place longest first.
        for end, (i, length) in self.automaton.iter(word):
            if last[end] != unset:
                continue
            start = end - length
            left = last[start] if start >= 0 else unset
            if left != unset:  # a character of no piece is never merged: anything may follow it
                pair = left << 20 | i
                fits = compatible.get(pair)
                if fits is None:
                    if len(compatible) >= CACHE_PAIRS:
                        compatible.clear()
                    fits = compatible[pair] = self._pair(self.pieces[left], self.pieces[i])
                if not fits:
                    continue
            last[end] = i
        ids: list[int] = []
        at = len(word) - 1
        while at >= 0:
            i = last[at]
            if i == unset:
                ids += [self.byte_ids[b] for b in reversed(word[at].encode("utf-8"))]
                at -= 1
            else:
                ids.append(i)
                at -= self.lengths[i]
        ids.reverse()
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without begin or end; of NULL and the empty text: none."""
        if not text:
            return []
        words, out = self.words, []
        for word in self.part.findall(MARK + text.replace(" ", MARK)):
            ids = words.get(word)
            if ids is None:
                ids = self._encode(word)
                if len(word) <= CACHE_CHARS:
                    if len(words) >= CACHE_WORDS:
                        words.clear()
                    words[word] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become spaces, byte pieces UTF-8 (U+FFFD where invalid)."""
        values, plain, silent = self.values, self.plain, self.silent
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in values:
                run.append(values[i])
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            if i not in silent:
                out.append(plain[i])
        if run:
            out.append(_utf8(run))
        text = "".join(out)
        # The mark that encoding puts before a text goes again.
        return text[1:] if text.startswith(" ") and ids and self._starts_with_mark(ids) else text

    def _starts_with_mark(self, ids: list[int]) -> bool:
        first = next((i for i in ids if i not in self.silent), None)
        return first is not None and self.pieces[first].startswith(MARK)


def _utf8(run: bytearray) -> str:
    """Valid sequences as text, every byte outside one as U+FFFD."""
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[at : at + size]).decode("utf-8"))
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=2)
def table(path: str) -> PrefixTable:
    """One table per Python worker and model."""
    return PrefixTable(path)


def encode(text: Column, path: str) -> Column:
    """Ids as ``array<int>``; NULL texts count as empty."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        own = table(path)
        return pd.Series([own.encode(t) for t in texts], dtype=object)

    return run(text)


def decode(ids: Column, path: str) -> Column:
    """Texts of ids; NULL counts as no ids."""

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        own = table(path)
        return pd.Series([own.decode([] if x is None else [int(i) for i in x]) for x in lists], dtype=object)

    return run(ids)


def round_trip(text: Column, path: str, with_ids: bool = False) -> Column:
    """``struct<n_tokens, ids_sha256, decoded_sha256>``: encodes, then decodes these ids; NULL counts as empty.

    The ids themselves stay in the task, unless ``with_ids`` asks for them as a fourth field: then a
    text is encoded once for both. Equal texts have equal results; an empty one has no ids.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        own, rows = table(path), []
        for text in texts:
            ids = own.encode(text)
            row = (
                len(ids),
                hashlib.sha256(",".join(map(own.names.__getitem__, ids)).encode()).hexdigest(),
                hashlib.sha256(own.decode(ids).encode("utf-8")).hexdigest(),
            )
            rows.append((*row, np.array(ids, np.int32)) if with_ids else row)
        return pd.DataFrame(rows, columns=names)

    return run(text)
